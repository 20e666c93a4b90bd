"""Format detection from content, hints and names; conflicts abstain."""

from __future__ import annotations

import csv
import json

# Leading bytes, name suffixes and hint aliases of formats.
MAGIC = ((b"\x89HDF\r\n\x1a\n", "hdf5"), (b"PAR1", "parquet"), (b"CDF\x01", "netcdf"), (b"CDF\x02", "netcdf"), (b"CDF\x05", "netcdf"), (b"PK\x03\x04", "zip"))
SUFFIXES = {".csv": "csv", ".tsv": "csv", ".h5": "hdf5", ".hdf5": "hdf5", ".hdf": "hdf5", ".he5": "hdf5", ".nc": "netcdf", ".cdf": "netcdf", ".parquet": "parquet", ".zarr": "zarr", ".fits": "fits", ".fit": "fits", ".grib": "grib", ".grb": "grib", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".xml": "xml", ".xsd": "xml", ".avro": "avro", ".arff": "arff", ".xlsx": "xlsx"}
ALIASES = {"auto": None, "binary": "raw_binary", "raw": "raw_binary", "raw_binary": "raw_binary", "timeseries": "csv", "time_series": "csv", "h5": "hdf5"}
SUPPORT = {"magic": 1.0, "zip": 0.98, "hint": 0.99, "json_probe": 0.9, "delimited_probe": 0.8, "suffix": 0.72}
PARSED = ("csv", "json", "xml", "parquet", "netcdf", "arff", "xlsx")
SNIFF = 8192
PROBE = 1 << 20


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def delimited_dialect(data: bytes) -> str | None:
    """Delimiter if the first lines of the prefix are equally wide tables of two columns or more."""
    head = data[:SNIFF]
    if b"\0" in head:
        return None
    try:
        text = head.decode("utf-8-sig", errors="strict" if len(data) <= SNIFF else "ignore")
        dialect = csv.Sniffer().sniff(text, delimiters=",\t;|")
    except (UnicodeDecodeError, csv.Error):
        return None
    rows = [r for r in csv.reader(text.splitlines(), dialect) if r][:5]
    widths = {len(r) for r in rows}
    return dialect.delimiter if len(widths) == 1 and widths.pop() >= 2 else None


def is_json(data: bytes) -> bool:
    body = data.removeprefix(b"\xef\xbb\xbf")
    if len(data) > PROBE or body.lstrip()[:1] not in (b"{", b"["):
        return False
    try:
        json.loads(body.decode("utf-8"))
    except ValueError:
        return False
    return True


def signals(path: str, data: bytes, hint: str | None = None) -> list[tuple[str, str, float]]:
    """(format, basis, support) of all signals."""
    out = []
    for lead, name in MAGIC:
        if data.startswith(lead):
            out.append((name, "magic", SUPPORT["zip"] if name == "zip" else SUPPORT["magic"]))
    hint = hint.strip().lower() if hint else None
    given = ALIASES.get(hint, hint) if hint else None
    if given:
        out.append((given, "hint", SUPPORT["hint"]))
    if (s := SUFFIXES.get(suffix_of(path))) is not None:
        out.append((s, "suffix", SUPPORT["suffix"]))
    if is_json(data):
        out.append(("json", "json_probe", SUPPORT["json_probe"]))
    if delimited_dialect(data):
        out.append(("csv", "delimited_probe", SUPPORT["delimited_probe"]))
    return out


def decide(found: list[tuple[str, str, float]]) -> tuple[str | None, str, bool]:
    """(format, basis, conflicted). Content against a hint, and JSON text against another suffix, are conflicts."""
    by = {basis: name for name, basis, _ in reversed(found)}
    magic, hint, probe, suffix = by.get("magic"), by.get("hint"), by.get("json_probe"), by.get("suffix")
    if magic == "zip":
        magic = "xlsx" if suffix == "xlsx" or hint == "xlsx" else magic
    if magic and hint and magic != hint and not (magic == "hdf5" and hint == "netcdf"):
        return None, "magic_hint_conflict", True
    for basis, name in (("magic", magic), ("hint", hint)):
        if name:
            return name, basis, False
    if probe and suffix and suffix != probe:
        return None, "content_suffix_conflict", True
    for basis in ("json_probe", "suffix", "delimited_probe"):
        if by.get(basis):
            return by[basis], basis, False
    return None, "no_signature", False


def abstention(name: str | None, basis: str, conflicted: bool) -> str | None:
    """Issue code where no reader may run, else None."""
    if conflicted:
        return "format_conflict"
    if name is None:
        return "no_recognized_signature"
    if name == "zip":
        return "container_not_parsed"
    if name == "hdf5":
        return "dependency_unavailable"
    return None if name in PARSED else "no_extractor"
