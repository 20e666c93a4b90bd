"""Evidence readers: files become facts with basis, coverage and locator; errors become outcome rows.

Files come from Spark's binaryFile source, so any file system works and each file is parsed in one task. A file
that fails anywhere yields no facts at all. Bounded prefixes are reported as coverage `sample`.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import abstention, decide, delimited_dialect, signals, suffix_of

LIMIT = 200
DOCUMENT, LINE, DEPTH, NODES = 8 << 20, 1 << 20, 32, 10_000
FACTS = "dataset_id string, path string, fact_id string, subject string, predicate string, value string, categories string, basis string, coverage string, locator string"
OUTCOMES = "dataset_id string, path string, format string, basis string, status string, issue string, facts long"
Fact = tuple[str, str, object, str, str, str]  # subject, predicate, value, categories, basis, locator


class Unreadable(ValueError):
    """The file can't be read as its format; the text is the issue."""


def dataset_id(path: str, content: bytes) -> str:
    return "ds_" + hashlib.sha256(path.encode() + b"\0" + hashlib.sha256(content).hexdigest().encode()).hexdigest()[:24]


def canonical_header(names: list[str]) -> list[str]:
    """Blank names become __unnamed_column_<i> (from 1), repeats <name>__duplicate_<n>, and none collides; others stay as they are."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        base = raw if raw.strip() else f"__unnamed_column_{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        name = base if seen[base] == 1 else f"{base}__duplicate_{seen[base]}"
        while name in out:
            seen[base] += 1
            name = f"{base}__duplicate_{seen[base]}"
        out.append(name)
    return out


def read_delimited(data: bytes, path: str, limit: int, header: bool = True) -> tuple[list[Fact], bool]:
    """Raw cells of the first rows and totals over all; white space and leading zeros stay."""
    text = data.decode("utf-8-sig")
    mark = delimited_dialect(data) or ("\t" if suffix_of(path) == ".tsv" else ",")
    facts: list[Fact] = [("$", "delimiter", {"\t": "tab"}.get(mark, mark), "syntax|encoding", "observed", "dialect")]
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
    names, total, bad = None, 0, 0
    for row in rows:
        if names is None:
            names = canonical_header(row) if header else [f"__column_{i}" for i in range(len(row))]
            if header:
                facts += [(n, "name", raw, "structure", "declared", f"header:{i}") for i, (n, raw) in enumerate(zip(names, row, strict=True))]
                continue
        total += 1
        bad += len(row) != len(names)
        if total <= limit:
            facts += [(n, "value", v, "value|syntax", "observed", f"row:{total}:col:{i}") for i, (n, v) in enumerate(zip(names, row, strict=False))]
    if names is None:
        raise Unreadable("empty_file")
    facts += [("$", "row_count", total, "structure", "observed", "file"), ("$", "width_conflicts", bad, "structure", "observed", "file")]
    return facts, total > limit


class _Number(str):
    pass


def _walk(value, pointer: str, limit: int, state: list, depth: int = 0) -> Iterator[Fact]:
    state[0] += 1
    if depth > DEPTH or state[0] > NODES:
        state[1] = True
        return
    if isinstance(value, dict):
        yield pointer, "type", "object", "structure", "observed", pointer
        for k, v in value.items():
            yield from _walk(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", limit, state, depth + 1)
    elif isinstance(value, list):
        yield pointer, "type", "array", "structure", "observed", pointer
        yield pointer, "length", len(value), "structure", "observed", pointer
        state[1] = state[1] or len(value) > limit
        for i, v in enumerate(value[:limit]):
            yield from _walk(v, f"{pointer}/{i}", limit, state, depth + 1)
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number) else "string"
        if kind == "number":
            kind = "integer" if re.fullmatch(r"-?\d+", value) else "number"
        yield pointer, "type", kind, "structure|encoding", "observed", pointer
        yield pointer, "value", value, "value", "observed", pointer


def _loads(text: str):
    def refuse(name):
        raise Unreadable(f"non_finite_number:{name}")

    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=refuse)


def read_json(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    """Pointers, types and lexical values; numbers keep their spelling. A bad line spoils the whole file."""
    text = data.decode("utf-8-sig")
    state = [0, False]
    if suffix_of(path) in (".jsonl", ".ndjson"):
        facts: list[Fact] = []
        n = 0
        for i, line in enumerate(text.splitlines(), 1):
            if not line.strip():
                continue
            if len(line) > LINE:
                raise Unreadable("line_too_long")
            value = _loads(line)
            n += 1
            if n <= limit:
                facts += [(s, p, v, c, b, f"line:{i}{loc}") for s, p, v, c, b, loc in _walk(value, "$", limit, state)]
        return facts, state[1] or n > limit
    if len(data) > DOCUMENT:
        raise Unreadable("document_too_large")
    value = _loads(text)
    if isinstance(value, dict) and ({"$schema", "$id"} & value.keys()) and value.get("type") and isinstance(value.get("properties"), dict):
        return declared_schema(value), False
    return list(_walk(value, "$", limit, state)), state[1]


def declared_schema(schema: dict, pointer: str = "#/properties") -> list[Fact]:
    """Declared facts of a JSON Schema's properties: type, required, enum, pattern, format, bounds."""
    facts: list[Fact] = []
    for name in sorted({*schema.get("properties", {}), *schema.get("required", [])}):
        own = schema.get("properties", {}).get(name, {})
        at = f"{pointer}/{name.replace('~', '~0').replace('/', '~1')}"
        facts.append((name, "required", name in schema.get("required", []), "structure", "declared", "#/required"))
        for key in ("type", "enum", "pattern", "format", "minimum", "maximum"):
            if key in own:
                facts.append((name, f"declared_{key}", own[key], "encoding" if key in ("type", "format") else "value|syntax", "declared", f"{at}/{key}"))
    return facts


def read_xml(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    """Element paths with occurrence numbers, attributes and raw text; the whole document must be well formed."""
    facts: list[Fact] = []
    stack: list[str] = []
    seen: dict[str, int] = {}
    n, xsd = 0, False
    for event, el in ET.iterparse(io.BytesIO(data), events=("start", "end")):
        tag = el.tag.rsplit("}", 1)[-1]
        if event == "start":
            if not stack and el.tag == "{http://www.w3.org/2001/XMLSchema}schema":
                xsd = True
            stack.append(tag)
            if len(stack) > 1024:
                raise Unreadable("too_deep")
            continue
        where = "/" + "/".join(stack)
        stack.pop()
        if xsd:
            if tag in ("element", "attribute") and "name" in el.attrib:
                kind = el.attrib.get("type", "").rsplit(":", 1)[-1]
                kind = "integer" if kind in ("int", "integer", "long", "short") else "number" if kind in ("decimal", "double", "float") else "boolean" if kind == "boolean" else "string" if kind == "string" else "unknown"
                facts += [(el.attrib["name"], "declared_type", kind, "encoding", "declared", where), (el.attrib["name"], "required", el.attrib.get("minOccurs", "1") != "0" if tag == "element" else el.attrib.get("use") == "required", "structure", "declared", where), (el.attrib["name"], "max_occurs", el.attrib.get("maxOccurs", "1"), "structure", "declared", where)]
            continue
        seen[where] = seen.get(where, 0) + 1
        n += 1
        if n <= limit:
            at = f"{where}[{seen[where]}]"
            if "}" in el.tag:
                facts.append((where, "namespace", el.tag[1:].split("}")[0], "structure", "observed", at))
            facts += [(f"{where}/@{k}", "value", v, "value", "observed", at) for k, v in el.attrib.items()]
            facts.append((where, "value", el.text, "value|syntax", "observed", at))
    facts += [(p, "occurrences", c, "structure", "observed", p) for p, c in seen.items()]
    return facts, n > limit


def read_arff(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    facts: list[Fact] = []
    names, rows, body = [], 0, False
    for i, line in enumerate(data.decode("utf-8-sig").splitlines(), 1):
        t = line.strip()
        if not t or t[0] == "%":
            continue
        if body:
            rows += 1
            if rows <= limit:
                facts.append(("$", "raw_row", line, "syntax", "observed", f"line:{i}"))
                cells = next(csv.reader([t], quotechar="'", skipinitialspace=True))
                if len(cells) != len(names):
                    raise Unreadable(f"row_width:{i}")
                facts += [(n, "value", "NaN" if c == "?" else c, "value", "observed", f"line:{i}") for n, c in zip(names, cells, strict=True)]
        elif m := re.match(r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)$", t):
            name, kind = m.group(1).strip("'\""), m.group(2).strip()
            names.append(name)
            if kind.startswith("{"):
                facts.append((name, "declared_enum", [c for c in next(csv.reader([kind.strip("{}")], quotechar="'", skipinitialspace=True))], "value|encoding", "declared", f"line:{i}"))
            else:
                facts.append((name, "declared_type", kind.lower(), "encoding", "declared", f"line:{i}"))
        elif t.lower() == "@data":
            body = True
    if not body:
        raise Unreadable("no_data_section")
    return facts, rows > limit


def read_xlsx(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    """Cells of each sheet: decoded text, raw token, number format and formula, from the package's XML."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    z = zipfile.ZipFile(io.BytesIO(data))
    load = lambda n: ET.fromstring(z.read(n)) if n in z.namelist() else None
    strings = ["".join(t.text or "" for t in si.iter("{%s}t" % ns["m"])) for si in (load("xl/sharedStrings.xml") if load("xl/sharedStrings.xml") is not None else ())]
    styles = load("xl/styles.xml")
    formats = {f.attrib["numFmtId"]: f.attrib["formatCode"] for f in styles.iterfind(".//m:numFmt", ns)} if styles is not None else {}
    xfs = [x.attrib.get("numFmtId", "0") for x in styles.iterfind(".//m:cellXfs/m:xf", ns)] if styles is not None else []
    facts: list[Fact] = []
    cut = False
    for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        label, names = sheet.rsplit("/", 1)[-1][:-4], {}
        for r, row in enumerate(ET.fromstring(z.read(sheet)).iterfind(".//m:row", ns)):
            if r > limit:
                cut = True
                break
            for c in row.iterfind("m:c", ns):
                ref, raw = c.attrib.get("r", ""), c.findtext("m:v", None, ns)
                col = re.sub(r"\d", "", ref)
                value = strings[int(raw)] if c.attrib.get("t") == "s" and raw is not None else c.findtext("m:is/m:t", raw, ns)
                if r == 0:
                    names[col] = value or col
                    facts.append((f"{label}.{names[col]}", "name", value, "structure", "declared", f"{label}!{ref}"))
                    continue
                subject = f"{label}.{names.get(col, col)}"
                facts += [(subject, "value", value, "value", "observed", f"{label}!{ref}"), (subject, "raw_token", raw, "syntax", "observed", f"{label}!{ref}")]
                if (f := c.findtext("m:f", None, ns)) is not None:
                    facts.append((subject, "formula", f, "syntax", "observed", f"{label}!{ref}"))
                if (s := c.attrib.get("s")) and int(s) < len(xfs) and (code := formats.get(xfs[int(s)])):
                    facts.append((subject, "number_format", code, "encoding", "declared", f"{label}!{ref}"))
    return facts, cut


def _arrow_children(name: str, kind) -> Iterator[tuple[str, str]]:
    import pyarrow as pa

    yield name, str(kind)
    if pa.types.is_struct(kind):
        for f in kind:
            yield from _arrow_children(f"{name}.{f.name}", f.type)
    elif pa.types.is_map(kind):
        yield from _arrow_children(f"{name}.key", kind.key_type)
        yield from _arrow_children(f"{name}.value", kind.item_type)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        yield from _arrow_children(f"{name}.element", kind.value_type)


def read_footer(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    """Schema, row groups, codecs and statistics of a Parquet footer; no row value is read."""
    import pyarrow.parquet as pq

    m = pq.ParquetFile(io.BytesIO(data)).metadata
    facts: list[Fact] = [("$", "row_count", m.num_rows, "structure", "declared", "footer"), ("$", "row_groups", m.num_row_groups, "structure", "declared", "footer")]
    for f in m.schema.to_arrow_schema():
        facts += [(n, "physical_type", t, "encoding", "declared", "footer:schema") for n, t in _arrow_children(f.name, f.type)]
    for i in range(m.num_columns):
        cols = [m.row_group(g).column(i) for g in range(m.num_row_groups)]
        name = m.schema.column(i).path
        facts.append((name, "compression", "|".join(sorted({c.compression for c in cols})), "encoding", "declared", "footer:columns"))
        stats = [c.statistics for c in cols]
        known = bool(stats) and all(s is not None and s.has_null_count for s in stats)
        facts.append((name, "null_count", sum(s.null_count for s in stats) if known else "unknown", "value", "declared", "footer:statistics"))
    return facts, False


def read_netcdf_classic(data: bytes, path: str, limit: int) -> tuple[list[Fact], bool]:
    """Dimensions, variables, attributes of a classic netCDF header (CDF 1, 2 and 5)."""
    wide, at = data[3], 4

    def number(size: int = 0) -> int:
        nonlocal at
        n = size or (8 if wide == 5 else 4)
        at += n
        return int.from_bytes(data[at - n : at], "big")

    def text() -> str:
        nonlocal at
        n = number()
        at += -(-n // 4) * 4
        return data[at - -(-n // 4) * 4 :][:n].decode("utf-8")

    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8, 7: 1, 8: 2, 9: 4, 10: 8, 11: 8}
    names = {1: "byte", 2: "char", 3: "short", 4: "int", 5: "float", 6: "double", 7: "ubyte", 8: "ushort", 9: "uint", 10: "int64", 11: "uint64"}
    codes = {1: "b", 3: "h", 4: "i", 5: "f", 6: "d", 7: "B", 8: "H", 9: "I", 10: "q", 11: "Q"}

    def attributes(owner: str) -> list[Fact]:
        nonlocal at
        tag, n = number(4), number()
        out: list[Fact] = []
        for _ in range(n if tag else 0):
            name, kind, count = text(), number(4), number()
            raw = data[at : at + count * sizes[kind]]
            at += -(-count * sizes[kind] // 4) * 4
            value = raw.decode("utf-8", "replace") if kind == 2 else list(struct.unpack(f">{count}{codes[kind]}", raw))
            out.append((owner, f"attribute:{name}", value, "encoding" if name in ("units", "scale_factor", "add_offset", "_FillValue") else "value", "declared", "header"))
            if name == "units":
                out.append((owner, "declared_unit", value, "encoding", "declared", "header"))
        flags = {p: v for _, p, v, *_ in out}
        meanings = str(flags.get("attribute:flag_meanings", "")).split()
        values = flags.get("attribute:flag_values", [])
        if meanings and isinstance(values, list) and len(values) == len(meanings):
            out += [(owner, f"code_meaning:{v}", w, "encoding|value", "declared", "header") for v, w in zip(values, meanings, strict=True)]
        return out

    try:
        number()
        tag, n = number(4), number()
        dims = [(text(), number()) for _ in range(n if tag else 0)]
        facts: list[Fact] = [(d, "dimension_size", s, "structure", "declared", "header") for d, s in dims] + attributes("$")
        tag, n = number(4), number()
        for _ in range(n if tag else 0):
            name = text()
            own = [number() for _ in range(number())]
            facts += attributes(name)
            kind = number(4)
            number()
            number(4 if wide == 1 else 8)
            facts += [(name, "physical_type", names[kind], "encoding", "declared", "header"), (name, "shape", [dims[d][1] for d in own], "structure", "declared", "header"), (name, "dimensions", [dims[d][0] for d in own], "structure", "declared", "header")]
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
        raise Unreadable("damaged_header") from e
    return facts, False


READERS = {"csv": read_delimited, "json": read_json, "xml": read_xml, "arff": read_arff, "xlsx": read_xlsx, "parquet": read_footer, "netcdf": read_netcdf_classic}


def parse(path: str, content: bytes, hint: str | None, limit: int) -> tuple[str | None, str, str, str | None, list[Fact], str]:
    """(format, basis, status, issue, facts, coverage) of one file."""
    header = hint != "csv_no_header"
    name, basis, conflicted = decide(signals(path, content, None if hint == "csv_no_header" else hint))
    if hint == "csv_no_header":
        name, basis, conflicted = "csv", "hint", False
    if issue := abstention(name, basis, conflicted):
        return name, basis, "abstained", issue, [], "none"
    try:
        facts, cut = read_delimited(content, path, limit, header) if name == "csv" else READERS[name](content, path, limit)
    except (ValueError, KeyError, IndexError, ET.ParseError, zipfile.BadZipFile, csv.Error, OSError) as e:
        return name, basis, "failed", str(e) if isinstance(e, Unreadable) else f"unreadable:{type(e).__name__}", [], "none"
    return name, basis, "partial" if cut else "success", "sampling_insufficient" if cut else None, facts, "sample" if cut else "full"


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, content) of files of any file system that Spark reads."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(paths).select("path", "content")


def outcomes(df: DataFrame, limit: int = LIMIT, hint: str | None = None) -> DataFrame:
    """One outcome row a file: format, basis, status and issue."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                name, basis, status, issue, facts, _ = parse(path, content, hint, limit)
                rows.append((dataset_id(path.rsplit("/", 1)[-1], content), path, name, basis, status, issue, len(facts)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return df.mapInPandas(run, OUTCOMES)


def facts(df: DataFrame, limit: int = LIMIT, hint: str | None = None) -> DataFrame:
    """Facts of all files that parse; ids are ordinal within the file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                *_, found, coverage = parse(path, content, hint, limit)
                own = dataset_id(path.rsplit("/", 1)[-1], content)
                rows += [(own, path, f"{own}:f{i:05d}", s, pred, _text(v), c, b, coverage, loc) for i, (s, pred, v, c, b, loc) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return df.mapInPandas(run, FACTS)


def zarr_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the metadata documents of a Zarr v2 store.

    Their names start with a dot, which Spark's file sources skip, so the driver lists the store; it does not
    descend below an array, where only chunks lie.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows, todo = [], [root]
    while todo:
        p = jvm.org.apache.hadoop.fs.Path(todo.pop())
        fs = p.getFileSystem(conf)
        listed = list(fs.listStatus(p))
        names = {x.getPath().getName(): x.getPath() for x in listed}
        for n in sorted(set(names) & {".zarray", ".zgroup", ".zattrs", ".zmetadata"}):
            stream = fs.open(names[n])
            rows.append((names[n].toString(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
        if ".zarray" not in names:
            todo += [x.getPath().toString() for x in listed if x.isDirectory()]
    return spark.createDataFrame(rows, "path string, content binary")


def zarr_arrays(df: DataFrame) -> DataFrame:
    """Arrays of Zarr v2 stores from their metadata files: path, shape, chunks, dtype, order, conflict.

    Direct documents win over consolidated ones; a difference is reported. df comes from zarr_metadata().
    """
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    t = df.select(parent.alias("parent"), name.alias("name"), F.col("content").cast("string").alias("text"))
    direct = t.filter("name = '.zarray'").select(F.col("parent").alias("array"), F.col("text").alias("direct"))
    listed = t.filter("name = '.zmetadata'").select("parent", F.explode(F.from_json(F.get_json_object("text", "$.metadata"), "map<string,string>")).alias("k", "v"))
    listed = listed.filter(F.col("k").endswith(".zarray")).select(F.concat("parent", F.lit("/"), F.regexp_replace("k", "/?\\.zarray$", "")).alias("array"), F.col("v").alias("listed"))
    j = direct.join(listed.withColumn("array", F.regexp_replace("array", "/$", "")), "array", "full_outer")
    schema = "shape array<long>, chunks array<long>, dtype string, `order` string, compressor string, filters string"
    doc = F.from_json(F.coalesce("direct", "listed"), schema)
    same = F.from_json("direct", schema).eqNullSafe(F.from_json("listed", schema))
    return j.select("array", doc.alias("d"), (F.col("direct").isNotNull() & F.col("listed").isNotNull() & ~same).alias("conflict")).select("array", "d.shape", "d.chunks", "d.dtype", F.col("d.order").alias("order"), "d.compressor", "conflict")


def parse_batch(spark: SparkSession, manifest: DataFrame, receipts: DataFrame | None, limit: int = LIMIT) -> DataFrame:
    """Outcomes of manifest(path) files; those whose cache key is in receipts(cache_key, ...) are reused, not parsed.

    The key binds content, limit and reader version. Missing files give a failed row.
    """
    found = files(spark, [r.path for r in manifest.select("path").toLocalIterator() if _exists(spark, r.path)])
    keyed = found.withColumn("cache_key", F.sha2(F.concat_ws("|", F.sha2("content", 256), F.lit(str(limit)), F.lit("reader1")), 256))
    fresh = keyed if receipts is None else keyed.join(receipts.select("cache_key"), "cache_key", "left_anti")
    parsed = outcomes(fresh.select("path", "content"), limit).join(fresh.select("path", "cache_key"), "path")
    missing = manifest.select("path").join(found.select("path").withColumn("path", F.regexp_replace("path", "^file:/+", "/")), "path", "left_anti")
    failed = missing.select(F.lit(None).cast("string").alias("dataset_id"), "path", F.lit(None).cast("string").alias("format"), F.lit("intake").alias("basis"), F.lit("failed").alias("status"), F.lit("missing_file").alias("issue"), F.lit(0).cast("long").alias("facts"), F.lit(None).cast("string").alias("cache_key"))
    out = parsed.select(*failed.columns).withColumn("reused", F.lit(False)).union(failed.withColumn("reused", F.lit(False)))
    if receipts is None:
        return out
    again = keyed.select("path", "cache_key").join(receipts.drop("path", "reused"), "cache_key").withColumn("reused", F.lit(True))
    return out.unionByName(again.select(*out.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def inside(root: str, relative: str) -> bool:
    """Whether a relative path stays under its root."""
    parts = relative.split("/")
    return bool(root) and not relative.startswith("/") and ".." not in parts and bool(relative.strip())
