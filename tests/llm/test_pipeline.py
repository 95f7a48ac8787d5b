"""The pipeline's stages against brute force on a small corpus."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bytesift.llm.queries import QUERIES, SQL
from tests.llm.test_llm import BPE, brute_lines, check_packing

LANGS = {"en": "the of and to in that with this from have", "de": "der die und nicht für über eine schön werden auf"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        lang = ["en", "de"][i % 2]
        words = [f"{w}{rng.integers(0, 400)}" if rng.random() < 0.7 else w for w in rng.choice(LANGS[lang].split(), 90)]
        lines = [" ".join(words[k : k + 10]) for k in range(0, 90, 10)]
        if i % 3 == 0:
            lines.insert(4, "All rights are with their owners.")
        rows.append((i, "\n".join(lines), lang, f"src{i % 12}", 0))
    text = rows[7][1]
    rows += [(1000, text, "de", "src1", 0), (1001, text + " extra", "de", "src2", 0), (1002, "12 34 !!", "en", "src3", 0), (1003, None, None, None, None), (1004, "", "en", "src3", 0)]
    rows = [(d, t, a, s, None if t is None else len(t)) for d, t, a, s, _ in rows]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda name: sorted(r.doc_id for r in kept[name].select("doc_id").collect())
    assert ids("language_id") == [*range(240), 1000, 1001]
    rows = [(r.doc_id, r.source, r.text) for r in kept["language_id"].collect()]
    lined = {r.doc_id: r for r in kept["line_dedup"].collect()}
    assert {d: r.text for d, r in lined.items()} == brute_lines(rows, corpus_pipeline.MIN_SITES)
    assert all(r.n_chars == len(r.text) for r in lined.values())
    sets = {}
    for d, r in lined.items():
        w = r.text.lower().split()
        sets[d] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = {max(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert ids("near_dedup") == sorted(set(sets) - alike) and {1000, 1001} <= alike
    mixed = Counter(ids("mixing"))
    assert max(mixed.values()) <= 4 and set(mixed) <= set(ids("near_dedup"))
    tk = Tokenizer.from_file(BPE)
    tokens = {r.doc_id: tk.encode(r.text, add_special_tokens=False).ids + [2] for r in kept["near_dedup"].collect()}
    pieces, _ = check_packing(kept["packing"].collect(), tokens, 1024)
    assert pieces == Counter({d: n * len(tokens[d]) for d, n in mixed.items()})


def test_run_and_empty_table(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(SQL) <= set(QUERIES)
