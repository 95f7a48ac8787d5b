"""Header fields that conditions can compare. Names are case-insensitive; some have aliases."""

from __future__ import annotations

# The fields of the rule language.
BOOLEANS = ("crx.is_crx", "pe.is_pe", "pe.is_32bit", "pe.is_64bit", "pe.is_dll", "pe.is_signed", "dotnet.is_dotnet", "dex.is_dex", "lnk.is_lnk", "elf.is_elf", "macho.is_macho")
INTEGERS = ("pe.machine", "pe.subsystem", "pe.timestamp", "pe.characteristics", "elf.type", "elf.os_abi", "elf.machine", "macho.cpu_type", "macho.cpu_subtype", "macho.file_type", "dex.version", "lnk.creation_time", "lnk.access_time", "lnk.write_time")
ALIASES = {"elf.osabi": "elf.os_abi", "macho.cputype": "macho.cpu_type", "macho.cpusubtype": "macho.cpu_subtype", "macho.filetype": "macho.file_type"}
IGNORED_MODULES = ("androguard", "console", "cuckoo")
#: The digests of whole files and their hexadecimal lengths.
DIGESTS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def canonical(name: str) -> str | None:
    """A field's own name, or None if there is no such field."""
    name = name.lower()
    name = ALIASES.get(name, name)
    return name if name in BOOLEANS or name in INTEGERS or name in ("math.entropy", "time.now", "filesize") else None


def column_name(field: str) -> str:
    return field.replace(".", "_")
