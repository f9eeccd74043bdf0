"""Readers with header aliases, and sinks."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from versight import lexicons as L
from versight.functions.store import written

CHUNKS = "chunk_id string, book_name string, chapter_id string, chapter_title string, chunk_index_global long, chunk_index_in_chapter int, text string, chunk_text string, character_mentions array<string>, event_mentions array<string>, plot_density_score double, source_path string, metadata struct<character_mention_count:int,event_mention_count:int,temporal_marker_count:int,capitalized_phrase_count:int,dialogue_marker_count:int>"


def resolve(columns: list[str], aliases=L.COLUMN_ALIASES, required=()) -> dict[str, str]:
    """Canonical name -> column; names are trimmed, lower-cased and freed of a byte order mark. The first alias wins, then the first column."""
    clean: dict[str, str] = {}
    for c in columns:
        clean.setdefault(c.lstrip("\ufeff").strip().lower(), c)
    found = {k: next((clean[a] for a in names if a in clean), None) for k, names in aliases.items()}
    if lost := [k for k in required if found[k] is None]:
        raise ValueError(f"missing columns {lost}: accepted {[aliases[k] for k in lost]}, available {columns}")
    return {k: v for k, v in found.items() if v is not None}


def read_examples(spark: SparkSession, path: str, *, labelled: bool) -> DataFrame:
    """Examples of a CSV file: trimmed, blanks as null; empty required fields and unknown labels raise when rows are read."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    found = resolve(raw.columns, required=("book_name", "character", "content", *(("label",) if labelled else ())))
    value = lambda k: F.nullif(F.trim(F.col(f"`{found[k]}`")), F.lit("")) if k in found else F.lit(None).cast("string")
    must = lambda k: F.coalesce(value(k), F.raise_error(F.lit(f"empty field: {k}")).cast("string")).alias(k)
    label = F.lower(value("label"))
    if labelled:
        label = F.when(label.isin(*L.LABELS), label).otherwise(F.raise_error(F.lit("bad label")).cast("string"))
    if "id" in found:
        row = value("id")
    else:
        raw, row = numbered(raw), F.col("_number").cast("string")
    return raw.select(row.alias("id"), must("book_name"), must("character"), must("content"), value("caption").alias("caption"), label.alias("label"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_number``, from 1 in the order of the rows: offsets of counts by partition, so no task sees all rows."""
    kept = written(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftrightunsigned("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def list_books(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, bytes, changed) of the .txt files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select("path", F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


STORE = "book_name string, chunk_text string, embedding array<float>"


def read_store(spark: SparkSession, path: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """A vector store of JSON lines; with ``flags`` those 0/1 fields too, as the map ``flags``."""
    rows = spark.read.schema(", ".join([STORE, *(f"`{f}` int" for f in flags)])).json(path)
    pairs = F.create_map(*(x for f in flags for x in (F.lit(f), F.col(f"`{f}`")))) if flags else F.expr("cast(map() as map<string,int>)")
    return rows.select("book_name", "chunk_text", "embedding", pairs.alias("flags"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, its types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a predictions file as text, ids trimmed."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).withColumn("id", F.trim("id"))


def read_trace(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of a pipeline's trace, of repeated examples the last written; ``schema`` is that of ``traces.pipeline_trace``."""
    rows = numbered(spark.read.schema(schema).json(path).where("example_id is not null"))
    return latest(rows, "example_id", "_number").drop("_number")


PROFILE = "mention_count long, first_mention_chunk string, first_mention_chapter string, high_signal_chunks array<string>, co_mentioned_characters array<string>, associated_locations array<string>, associated_roles array<string>, associated_dates array<string>, important_event_types array<string>"
PAIR = "same_chunk long, same_chapter long, nearby_chunks long"


def write_constraint_index(profiles: DataFrame, graph: DataFrame, path: str) -> None:
    """The index as one JSON document: characters by name, and pairs by their key. Both are bounded by the lexicon of names."""
    rows = profiles.select("character", F.to_json(F.struct(*(c.split()[0] for c in PROFILE.split(", ")))).alias("x")).collect()
    pairs = graph.select(F.concat_ws("||", "left", "right").alias("k"), F.to_json(F.struct("same_chunk", "same_chapter", "nearby_chunks")).alias("x")).collect()
    whole = {"characters": {r[0]: json.loads(r[1]) for r in rows}, "cooccurrence": {r[0]: json.loads(r[1]) for r in pairs}}
    _write_text(profiles.sparkSession, path, json.dumps(whole, ensure_ascii=False, indent=2, sort_keys=True))


def read_constraint_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, graph) of the document."""
    raw = spark.read.text(path, wholetext=True)
    x = raw.select(F.from_json("value", f"characters map<string, struct<{PROFILE.replace(' ', ':').replace(',:', ', ')}>>, cooccurrence map<string, struct<{PAIR.replace(' ', ':').replace(',:', ', ')}>>").alias("j"))
    profiles = x.select(F.explode("j.characters").alias("character", "p")).select("character", "p.*")
    graph = x.select(F.explode("j.cooccurrence").alias("k", "p")).select(F.split("k", r"\|\|")[0].alias("left"), F.split("k", r"\|\|")[1].alias("right"), "p.*")
    return profiles, graph


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hard, soft) rules of a document ``characters: {name: {hard_constraints: [{description, patterns}], soft_terms}}``.

    JSON, which is YAML too, is read as it stands; other YAML needs a parser that can be imported.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        whole = json.loads(text)
    except ValueError:
        import yaml

        whole = yaml.safe_load(text) or {}
    hard, soft = [], []
    for name, rules in (whole.get("characters") or {}).items():
        hard += [(name, str(h.get("description") or "constraint hit"), [str(p) for p in h.get("patterns") or []]) for h in (rules or {}).get("hard_constraints") or []]
        soft += [(name, str(t)) for t in (rules or {}).get("soft_terms") or []]
    return spark.createDataFrame(hard, "character string, description string, patterns array<string>"), spark.createDataFrame(soft, "character string, term string")


FRAME = "frame_id string, book_name string, character string, event_type string, surface_text string, chunk_id string, chapter_id string, chunk_index_global long, temporal_markers array<string>, location_markers array<string>, confidence double"


def write_timeline_map(frames: DataFrame, path: str) -> None:
    """A line for each frame, in folders by character: the map's entries, which ``read_timeline`` takes as well as one document."""
    names = [c.split()[0] for c in FRAME.split(", ")]
    frames.select(F.to_json(F.create_map("character", F.array(F.struct(*names)))).alias("value"), F.col("character").alias("part")).write.mode("overwrite").partitionBy("part").text(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Frames of ``{character: [frame, ...]}``: a document, or lines that are parts of it."""
    struct = ", ".join(c.replace(" ", ":", 1) for c in FRAME.split(", "))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.when(F.trim("value").rlike(r"\}\s*\n\s*\{\""), F.split("value", "\n")).otherwise(F.array("value")), lambda x: F.trim(x) != "")).alias("value"))
    return rows.select(F.from_json("value", f"map<string, array<struct<{struct}>>>").alias("m")).select(F.explode("m")).select(F.explode("value").alias("f")).select("f.*")


def environment(names: dict[str, object], *, prefix: str, dotenv: str | None = ".env") -> dict[str, object]:
    """Settings by name: the environment's NAME, then with the prefix, then those of the dotenv file, then the default.

    Values take the type of the default; truth is 1, true, yes or on. Empty values count as not set.
    """
    found: dict[str, str] = {}
    if dotenv and Path(dotenv).exists():
        for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    out = {}
    for name, default in names.items():
        raw = os.environ.get(name) or os.environ.get(prefix + name) or found.get(name) or found.get(prefix + name)
        if raw is None:
            out[name] = default
        elif isinstance(default, bool):
            out[name] = raw.strip().lower() in {"1", "true", "yes", "on"}
        else:
            out[name] = type(default)(raw) if default is not None else raw
    return out


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, by the file system that Spark uses for the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """(book_name, text, path): one row per .txt file; the name is the decoded file name without its ending."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    name = F.url_decode(F.col("_metadata.file_name"))
    return files.select(F.regexp_replace(name, r"\.txt$", "").alias("book_name"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; ``chunk_text`` stands in for ``text``."""
    none = F.expr("cast(array() as array<string>)")
    rows = spark.read.schema(CHUNKS).json(path)
    return rows.withColumns({"text": F.coalesce("text", "chunk_text"), "character_mentions": F.coalesce("character_mentions", none), "event_mentions": F.coalesce("event_mentions", none), "plot_density_score": F.coalesce("plot_density_score", F.lit(0.0))}).drop("chunk_text").where("text is not null")


def read_labels(spark: SparkSession, path: str, kinds=("predicted_label", "prediction", "label", "final_label", "pred_label", "gold_label", "actual_label")) -> DataFrame:
    """(id, label) of a CSV file; empty and repeated ids raise."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    found = resolve(raw.columns, {"id": L.COLUMN_ALIASES["id"], "label": kinds}, required=("id", "label"))
    rows = raw.select(F.trim(F.col(f"`{found['id']}`")).alias("id"), F.col(f"`{found['label']}`").alias("label"))
    if not rows.where("id is null or id = ''").isEmpty():
        raise ValueError("empty id")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("repeated id")
    return rows


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a cache in JSON lines; lines that do not parse are left out."""
    return spark.read.schema("key string, provider string, model string, temperature double, output string").option("mode", "DROPMALFORMED").json(path).where("key is not null")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_timeline(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("character").parquet(path)


def append_cache(answers: DataFrame, path: str) -> None:
    """Adds entries (key, provider, model, temperature, messages, response) to a cache; each call is a new set of files."""
    answers.select("key", "provider", "model", "temperature", "messages", F.col("response").alias("output")).write.mode("append").json(path)


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """The twelve columns in their order."""
    write_csv(rows.select(*L.PREDICTION_COLUMNS), path)


def write_errors(rows: DataFrame, path: str) -> None:
    """``traces.error_rows`` as CSV, ids in their order over the files."""
    from versight.operators import traces, verify

    write_csv(rows.select(*traces.ERROR_COLUMNS).orderBy(*verify.id_order("id")), path)


def write_split(rows: DataFrame, path: str) -> None:
    """train and dev below ``path``, from ``is_dev``."""
    for name, part in (("train", "not is_dev"), ("dev", "is_dev")):
        write_csv(rows.where(part).drop("is_dev"), f"{path}/{name}")


def write_confusion(cells: DataFrame, path: str, labels=L.LABELS) -> None:
    """Actual labels by rows, predicted ones by columns."""
    wide = cells.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n")).fillna(0)
    write_csv(wide.orderBy("actual").coalesce(1), path)


def metrics_json(row: DataFrame) -> str:
    """One row of metrics as a document with sorted keys."""
    return json.dumps(row.first().asDict(), sort_keys=True, indent=2)


def write_document(spark: SparkSession, text: str, path: str) -> None:
    _write_text(spark, path, text)


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report: small tables, and text as it is."""
    parts = [f"# {title}", ""]
    for name, body in sections.items():
        parts += [f"## {name}", "", body if isinstance(body, str) else markdown(body), ""]
    return "\n".join(parts)


def show(df: DataFrame, rows: int = 20) -> None:
    """Prints the first rows."""
    df.show(rows, truncate=80)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a table; reports are a few rows."""
    rows = [[f"{v:.6f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(limit).collect()]
    return "\n".join(f"| {' | '.join(r)} |" for r in [df.columns, ["---"] * len(df.columns), *rows])
