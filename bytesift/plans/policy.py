"""What a table of documents is made with: fixed when it is created."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from bytesift.functions.bloom import bits_per_gram
from bytesift.functions.fields import DIGESTS


@dataclass(frozen=True)
class Policy:
    """store_path: whether documents keep their external_id, which verification reopens contents by."""

    id_source: str = "sha256"
    store_path: bool = False
    grams: tuple[int, int] = (3, 4)
    tier1_fp: float = 0.4
    tier2_fp: float = 0.25
    shards: int = 8
    tree_docs: int = 5000
    dedup_min_docs: int = 1000
    compaction_cooldown_s: float = 5.0
    max_folders: int = 64

    def __post_init__(self):
        if self.id_source not in DIGESTS:
            raise ValueError(f"id_source is one of {', '.join(DIGESTS)}")
        a, b = self.grams
        if not 3 <= a < b <= 8:
            raise ValueError("gram sizes are 3 <= tier 1 < tier 2 <= 8")
        for p in (self.tier1_fp, self.tier2_fp):
            if not 0.01 <= p <= 0.5:
                raise ValueError("rates of false hits are from 0.01 to 0.5")
        if self.shards < 1 or self.tree_docs < 1:
            raise ValueError("there is one shard and one document a tree at least")

    def bits(self, tier: int) -> int:
        return bits_per_gram(self.tier1_fp if tier == 1 else self.tier2_fp)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Policy:
        own = json.loads(text)
        return cls(**own | {"grams": tuple(own["grams"])})

    def searches_with(self, other: Policy) -> bool:
        """Whether tables of two policies can be searched as one."""
        return (self.id_source, self.grams, self.bits(1), self.bits(2)) == (other.id_source, other.grams, other.bits(1), other.bits(2))
