"""Mapping persistence: the JSON edge and the table form (A3, A4).

JSON shape: ``{"PERSON": {"original": "fake", ...}, "EMAIL": {...}}``.

* Missing, unreadable, invalid or non-object files load as an empty mapping.
* A category whose value is not an object is ignored (only that category).
* Blank replacements are ignored with a warning (a blank fake would be
  "contained" in every value and suppress everything).
* Ids are not stored: they are read back from the fakes, so a loaded map is
  extended like a table.

The object is written as a folder of part files, one entry a line and sorted by
type, whose concatenation in the order of their names is the JSON object.  Such
a folder, and any indented JSON file with an entry a line, is read line by line
in parallel: a line's type is the last header line before it, by file, block and
line.  Only header and closing lines (two a type) reach the driver, which checks
the object's structure with them.  JSON in another layout (all in one line) is
parsed as one document; that form is for small files.

The table forms, parquet or JSON lines (a ``.jsonl`` folder), are partitioned by
``pii_type``.  Write all forms to a new path each run, never over the path being read.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, normalize_key
from ..operators.mapping import MAPPING_SCHEMA, empty_mapping, with_ids
from ..session import written

# Lines of an indented JSON object of objects.
STRING = r'"(?:[^"\\]|\\.)*+"'
ENTRY = rf"^\s*{STRING}\s*:\s*[^\s{{\[].*$"
HEADER = rf"^\s*{STRING}\s*:\s*\{{\s*$"
CLOSE = r"^\s*\}\s*,?\s*$"
OPEN = r"^\s*\{\s*$"
STRUCTURE_LINES = 20_000      # more opening and closing lines than that are no mapping by type


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def mapping_rows(entries: DataFrame) -> DataFrame:
    """Mapping rows of (pii_type, pos, surface, replacement): the first entry of a key counts, blank fakes go."""
    rows = entries.where(F.length(F.trim("replacement")) > 0).withColumn("norm_key", normalize_key(F.col("surface")))
    first = rows.groupBy("pii_type", "norm_key").agg(F.min_by(F.struct("surface", "replacement"), "pos").alias("e"))
    return first.select("pii_type", "norm_key", "e.surface", "e.replacement", F.lit(None).cast("bigint").alias("id"))


def mapping_from_json_text(doc: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse a one-column DataFrame of whole JSON documents into mapping rows.

    Two-step parse: the root as ``map<string,string>`` (each category kept as
    raw JSON), then each category as ``map<string,string>``.  A category that
    is not an object parses to null and is dropped alone.
    """
    root = doc.select(F.explode(F.from_json(F.col(text_col), "map<string,string>")).alias("pii_type", "raw"))
    cats = root.select("pii_type", F.from_json(F.col("raw"), "map<string,string>").alias("entries"))
    return mapping_rows(cats.where(F.col("entries").isNotNull()).select(
        "pii_type", F.posexplode("entries").alias("pos", "surface", "replacement")))


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line, kind) of the non-blank lines of a JSON file or of a folder of part files."""
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(pos.alias("pos"), F.col("value").alias("line")).where(F.col("line").rlike(r"\S"))
    kind = F.when(F.col("line").rlike(HEADER), "header").when(F.col("line").rlike(CLOSE), "close") \
        .when(F.col("line").rlike(OPEN), "open").when(F.col("line").rlike(ENTRY), "entry")
    return lines.withColumn("kind", kind)


def _categories(structure: list) -> list[tuple] | None:
    """(name, position of its header, position of its end) of every category; None if the lines are no object of objects."""
    import json
    kinds = [r["kind"] for r in structure]
    if len(kinds) < 2 or kinds[0] != "open" or kinds[-1] != "close" or structure[-1]["line"].strip() != "}":
        return None
    body = structure[1:-1]
    if len(body) % 2 or any(r["kind"] != ("header", "close")[i % 2] for i, r in enumerate(body)):
        return None
    if ["," in r["line"] for r in body[1::2]] != [True] * (len(body) // 2 - 1) + [False] * bool(body):
        return None
    try:
        return [(json.loads(re.match(rf"\s*({STRING})", h["line"])[1]), h["pos"], c["pos"]) for h, c in zip(body[::2], body[1::2])]
    except ValueError:
        return None


def _mapping_from_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Mapping entries (pii_type, pos, surface, replacement) of an indented JSON object, read in
    parallel; None if the text has another layout.  Raises a ValueError if its braces do not match."""
    lines = written(_json_lines(spark, path), "json-lines")
    if not lines.where("kind is null").isEmpty():
        return None
    outline = lines.where("kind in ('open', 'header', 'close')")
    if outline.count() > STRUCTURE_LINES:
        return None
    structure = sorted(outline.collect(), key=lambda r: tuple(r["pos"]))
    if 2 * sum(r["kind"] == "close" for r in structure) != len(structure):
        raise ValueError("braces do not match")
    found = _categories(structure)
    if found is None:
        return None
    schema = "pii_type string, nr int, first struct<file:string,block:long,row:long>, last struct<file:string,block:long,row:long>"
    cats = spark.createDataFrame([(name, i, tuple(a), tuple(b)) for i, (name, a, b) in enumerate(found)], schema)
    # At most STRUCTURE_LINES / 2 categories: a range join on their positions.
    inside = lines.where("kind = 'entry'").join(F.broadcast(cats), F.col("pos").between(F.col("first"), F.col("last")), "left")
    comma = F.col("line").rlike(r",\s*$")
    open_ends = inside.groupBy("nr").agg(F.count_if(~comma).alias("ends"), F.max("pos").alias("at"),
                                         F.max(F.when(~comma, F.col("pos"))).alias("end"))
    if not open_ends.where("nr is null or ends <> 1 or at <> end").isEmpty():
        return None                                   # an entry outside the categories, a missing or a surplus comma
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("line", r",\s*$", ""), F.lit("}")), "map<string,string>")
    parsed = inside.select("pii_type", "nr", "pos", F.map_entries(entry).alias("e"))
    if not parsed.where("e is null or size(e) <> 1").isEmpty():
        return None
    lasts = {name: i for i, (name, *_) in enumerate(found)}     # of categories of one name the last counts
    kept = parsed.where(F.col("nr").isin(list(lasts.values())) if lasts else F.lit(False))
    return kept.select("pii_type", "pos", F.get("e", F.lit(0))["key"].alias("surface"),
                       F.get("e", F.lit(0))["value"].alias("replacement"))


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Load a mapping: a JSON object (``.json``, a file or a folder of parts), JSON lines
    (``.jsonl``) or parquet.  Unreadable JSON gives an empty mapping and a warning."""
    if path is None or not _path_exists(spark, path):
        return empty_mapping(spark)
    if path.endswith(".jsonl"):
        return spark.read.schema(MAPPING_SCHEMA).json(path).select(*empty_mapping(spark).columns)
    if path.endswith(".json"):
        try:
            entries = _mapping_from_lines(spark, path)
        except ValueError:
            warnings.warn(f"{path} is not a JSON object; starting with an empty mapping")
            return empty_mapping(spark)
        if entries is not None:
            blanks = entries.where(F.col("replacement").isNull() | (F.length(F.trim("replacement")) == 0)).count()
            out = mapping_rows(entries)
        else:
            doc = spark.read.text(path, wholetext=True)
            # from_json alone would keep the beginning of a broken object
            valid = F.json_object_keys("value").isNotNull() & F.from_json("value", "map<string,string>").isNotNull()
            if doc.where(~valid & (F.length(F.trim("value")) > 0)).count():
                warnings.warn(f"{path} is not a JSON object; starting with an empty mapping")
            doc = doc.where(valid)
            blanks = mapping_from_json_text_blank_count(doc)
            out = mapping_from_json_text(doc)
        if blanks:
            warnings.warn(f"ignored {blanks} blank replacement(s) in {path}")
        return written(with_ids(out), "loaded")          # parsed once, however often it is read
    return spark.read.schema(MAPPING_SCHEMA).parquet(path)


def mapping_from_json_text_blank_count(doc: DataFrame) -> int:
    root = doc.select(F.explode(F.from_json(F.col("value"), "map<string,string>")).alias("t", "raw"))
    ent = root.select(F.explode(F.from_json("raw", "map<string,string>")).alias("k", "v"))
    return ent.where(F.col("v").isNull() | (F.length(F.trim("v")) == 0)).count()


def mapping_json_lines(mapping: DataFrame) -> DataFrame:
    """The lines of the JSON object, sorted: (pii_type, surface, line).  A sort by type and
    surface, so that a type with very many entries is spread over many tasks."""
    ends = mapping.groupBy("pii_type").agg(F.min("surface").alias("low"), F.max("surface").alias("high"))
    types = ends.agg(F.min("pii_type").alias("first_type"), F.max("pii_type").alias("last_type"))       # one row
    rows = mapping.select("pii_type", "surface", "replacement").join(F.broadcast(ends), "pii_type").crossJoin(F.broadcast(types))
    entry = F.to_json(F.create_map("surface", "replacement"))
    quoted = F.substring(F.to_json(F.create_map("pii_type", F.lit(1))), 2, 1 << 30)                     # "TYPE":1}
    header = F.concat(F.lit("    "), F.regexp_replace(quoted, r":1\}$", ": {\n"))
    line = F.concat(
        F.when((F.col("surface") == F.col("low")) & (F.col("pii_type") == F.col("first_type")), F.lit("{\n")).otherwise(""),
        F.when(F.col("surface") == F.col("low"), header).otherwise(""),
        F.lit("        "), F.substr(entry, F.lit(2), F.length(entry) - 2),
        F.when(F.col("surface") < F.col("high"), F.lit(",")).when(F.col("pii_type") < F.col("last_type"), F.lit("\n    },"))
        .otherwise("\n    }\n}"))
    return rows.select("pii_type", "surface", line.alias("line")).orderBy("pii_type", "surface")


def save_mapping(mapping: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the whole mapping once, in parallel: ``parquet`` and ``jsonl`` partitioned by
    type, ``json`` as the parts of one JSON object."""
    if fmt == "jsonl":
        mapping.write.mode("overwrite").partitionBy("pii_type").json(path)
    elif fmt == "json":
        lines = mapping_json_lines(mapping)
        if mapping.isEmpty():
            lines = mapping.sparkSession.createDataFrame([("{\n}",)], "line string")
        lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    else:
        mapping.write.mode("overwrite").partitionBy("pii_type").parquet(path)


__all__ = ["load_mapping", "save_mapping", "mapping_json_lines", "mapping_from_json_text", "collapse_ws"]
