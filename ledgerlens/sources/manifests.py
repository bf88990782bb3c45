"""Manifests, JSON lines and metadata stores as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, first_present

MANIFEST = "doc_id string, company_name string, code string, report_year int, title string, doc_type string, language string, aliases string, status string, file_path string"


def read_manifest_csv(spark: SparkSession, path: str, schema: str = MANIFEST, recursive: bool = False) -> DataFrame:
    """Every column by name, values trimmed, empty ones null; `_pos` keeps the order within a file."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive)
    if recursive:
        reader = reader.option("pathGlobFilter", "manifest.csv")
    rows = reader.csv(path)
    rows = rows.select(*[clean_scalar(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns], F.col("_metadata.file_path").alias("_file")).withColumn("_pos", F.monotonically_increasing_id())
    return conform(rows, schema)


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of `schema`, missing ones null, values that don't fit null; technical columns stay."""
    have = {c.lower(): c for c in rows.columns}
    out = []
    for field in schema.split(","):
        name, kind = field.split()
        out.append((F.col(f"`{have[name]}`").try_cast(kind) if name in have else F.lit(None).cast(kind)).alias(name))
    return rows.select(*out, *[c for c in rows.columns if c.startswith("_")])


def read_manifest_json(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A list of rows, or an object with the list under "documents" or "items"."""
    raw = spark.read.option("multiLine", True).json(path)
    for name in ("documents", "items"):
        if name in raw.columns:
            raw = raw.where(F.col(name).isNotNull()).select(F.inline(name))
            break
    return conform(raw.withColumn("_pos", F.monotonically_increasing_id()), schema)


#: Names that columns of other manifests stand under (fixed values): the first that a row has counts.
ALIASES = {
    "doc_id": ("doc_id", "sha1", "sha1_name", "report_id"), "company_name": ("company_name", "company"), "code": ("security_code", "code", "stock_code"), "report_year": ("report_year", "fiscal_year", "year"),
    "title": ("report_title", "title"), "doc_type": ("doc_source_type", "doc_type", "document_type"), "language": ("language", "lang"), "aliases": ("company_aliases", "aliases"),
}


def canonical_columns(rows: DataFrame, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows under canonical names: of each name's columns the first that holds something; other columns stay."""
    names = names or ALIASES
    have = {c.lower(): c for c in rows.columns}
    out, used, kinds = [], set(), dict(rows.dtypes)
    for name, alternatives in names.items():
        found = [have[a] for a in alternatives if a in have]
        used |= set(found)
        if found:
            out.append(first_present(*[F.col(f"`{c}`") for c in found]).cast(kinds[found[0]]).alias(name))
    return rows.select(*out, *[F.col(f"`{c}`") for c in rows.columns if c not in used])


def normalize_manifest(rows: DataFrame) -> DataFrame:
    """Canonical names, aliases as an array with the company's name first, classes of documents, language codes."""
    out = canonical_columns(rows)
    if "aliases" in out.columns:
        named = F.array_compact(F.array(clean_scalar(F.col("company_name")))) if "company_name" in out.columns else F.array().cast("array<string>")
        out = out.withColumn("aliases", F.array_distinct(F.concat(named, F.coalesce(split_aliases(F.col("aliases")), F.array().cast("array<string>")))))
    if "doc_type" in out.columns:
        out = out.withColumn("doc_type", doc_type_class(F.col("doc_type")))
    return out.withColumn("language", language_code(F.col("language"))) if "language" in out.columns else out


def read_manifest(spark: SparkSession, root: str, schema: str = MANIFEST) -> DataFrame:
    """The manifest of a folder: manifest.csv, else manifest.json, else subset.csv, whichever is there first."""
    for name, read in (("manifest.csv", read_manifest_csv), ("manifest.json", read_manifest_json), ("subset.csv", read_manifest_csv)):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return read(spark, f"{root}/{name}", schema)
    raise FileNotFoundError(f"no manifest in {root}")


def last_wins(rows: DataFrame, key: str = "doc_id", order: str = "_pos") -> DataFrame:
    """Of rows with one key the last."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def split_aliases(text: Column) -> Column:
    """Distinct aliases, parted by any of seven separators."""
    return F.array_distinct(F.filter(F.transform(F.split(F.translate(text, "|；;、，/", ",,,,,,"), ","), lambda a: F.trim(a)), lambda a: a != ""))


def language_code(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.startswith("zh") | low.isin("cn", "chinese", "中文"), "zh").when(low.startswith("en") | (low == "english"), "en").otherwise(low)


def doc_type_class(text: Column) -> Column:
    """Class by keyword (fixed values), the first that fits."""
    low = F.lower(text)
    return F.when(low.rlike("annual|年报|年度"), "annual_report").when(low.rlike("research|研报|研究"), "research_report").when(low.rlike("quarter|季"), "quarterly_report").when(low.rlike("announce|公告"), "announcement").otherwise("other")


def merge_meta(manifest: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Manifest left joined with document metadata, whose values win where they are present."""
    m = meta.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__m_{c}") for c in meta.columns if c != key])
    joined = manifest.join(m, F.col(key) == F.col("__k"), "left")
    shared = [c for c in manifest.columns if c in meta.columns and c != key]
    kinds = dict(manifest.dtypes)
    both = {c: first_present(F.col(f"__m_{c}"), F.col(c)).cast(kinds[c]) for c in shared}
    return joined.select(*[both[c].alias(c) if c in both else F.col(c) for c in manifest.columns], *[F.col(f"__m_{c}").alias(c) for c in meta.columns if c not in manifest.columns])


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def materialise(manifest: DataFrame, files: DataFrame, existing: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(dataset, stale): rows of the manifest that succeeded and whose file is there, one per document, and documents of the
    dataset before that are in it no longer.

    manifest: doc, status (null or empty counts as success), file_path. files: file_path. existing: doc. A document with two
    different files fails the query when it runs. Its rows lie in order of the document once written sorted.
    """
    good = manifest.where(F.coalesce(F.lower(F.trim("status")), F.lit("")).isin("", "success")).join(files.select("file_path").distinct(), "file_path", "left_semi")
    n = F.size(F.collect_set("file_path").over(Window.partitionBy(doc)))
    check = F.when(n > 1, F.raise_error(F.concat(F.lit("several files of document "), F.col(doc).cast("string")))).otherwise(F.lit(True))
    rows = good.withColumn("__ok", check.cast("boolean")).where("__ok").drop("__ok").dropDuplicates([doc])
    return rows, existing.select(doc).distinct().join(rows.select(doc), doc, "left_anti")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, failing when they run if a key repeats: no separate pass decides."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    check = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    return rows.withColumn("__ok", check.cast("boolean")).where("__ok").drop("__ok")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read, or is left out where not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """New rows replace old ones of their key; without overwrite old ones stay."""
    if overwrite:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def write_store(tables: dict[str, DataFrame], path: str, year: str = "report_year") -> None:
    """One parquet table per entity, partitioned by year where it has one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(year) if year in df.columns else writer).parquet(f"{path}/{name}")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines; appended files keep what is there."""
    rows.write.mode("append" if append else "overwrite").json(path)


def json_to_csv(spark: SparkSession, source: str, target: str, schema: str = MANIFEST) -> None:
    """A JSON manifest as CSV with a head."""
    read_manifest_json(spark, source, schema).drop("_pos").write.mode("overwrite").option("header", True).csv(target)


def review_checklist(questions: DataFrame, path: str) -> None:
    """What reviewers tick off: a row per question in order, with empty columns for their verdicts."""
    cols = ["question_id", "kind", "question_text", "value", "pages"]
    rows = questions.select(*[(F.array_join(F.col(c).cast("array<string>"), ";") if dict(questions.dtypes)[c].startswith("array") else F.col(c)).alias(c) for c in cols])
    rows = rows.withColumns({c: F.lit("") for c in ("reviewed", "correct", "comment")})
    rows.repartitionByRange("question_id").sortWithinPartitions("question_id").write.mode("overwrite").option("header", True).csv(path)


def write_indexes(chunks: DataFrame, tokens: Column, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Postings (term, key, size, tf) dealt to files by term, and document frequencies, written once for all questions."""
    rows = chunks.select(key, F.size(F.array_distinct(tokens)).alias("size"), F.explode(tokens).alias("term")).groupBy(key, "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    # a hot term's rows are dealt to several tasks of its bucket
    rows.select("term", key, "size", "tf", bucket).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def write_run(answers: DataFrame, path: str, run: str) -> None:
    """Answers of one run beside those of others: a run is a partition, nothing is overwritten but itself."""
    answers.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def next_run(spark: SparkSession, path: str, name: str) -> str:
    """A run's name that is not taken: name, name_01, name_02 and so on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = {s.getPath().getName().removeprefix("run=") for s in fs.listStatus(where)} if fs.exists(where) else set()
    if name not in taken:
        return name
    return next(f"{name}_{i:02d}" for i in range(1, len(taken) + 2) if f"{name}_{i:02d}" not in taken)


def latest_run(spark: SparkSession, path: str, name: str) -> str | None:
    """The last of a name's runs, or none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [s.getPath().getName().removeprefix("run=") for s in fs.listStatus(where)] if fs.exists(where) else []
    numbered = {n: int(n[len(name) + 1 :]) if n != name else 0 for n in taken if n == name or (n.startswith(f"{name}_") and n[len(name) + 1 :].isdigit())}
    return max(numbered, key=numbered.get, default=None)


ANSWER = "question_id string, question_text string, question string, kind string, value string, confidence string, error string"


def read_answers(spark: SparkSession, path: str, schema: str = ANSWER) -> DataFrame:
    """Answers of a bundle in any of its three shapes: an object with a list "answers" or "questions", or a list."""
    row = f"array<struct<{', '.join(f.replace(' ', ':', 1).strip() for f in (x.strip() for x in schema.split(',')))}>>"
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("t"))
    whole = F.from_json("t", f"struct<answers:{row}, questions:{row}>")
    rows = F.when(F.col("t").startswith("["), F.from_json("t", row)).otherwise(F.coalesce(whole["answers"], whole["questions"]))
    return text.select(F.posexplode(rows).alias("pos", "a")).select("pos", "a.*")


def debug_index(bundle: DataFrame, questions: str = "questions", details: str = "answer_details") -> DataFrame:
    """(question_text, detail) of a debug bundle, a question's details being those at its place."""
    pairs = bundle.select(F.explode(F.arrays_zip(F.col(questions).alias("q"), F.col(details).alias("d"))).alias("x"))
    text = F.coalesce(F.nullif("x.q.question_text", F.lit("")), F.nullif("x.q.question", F.lit("")))
    return pairs.select(text.alias("question_text"), F.col("x.d").alias("detail")).where("question_text is not null")


def resume(questions: DataFrame, answers: DataFrame, key: str = "question_id", text: str | None = None, kind: str | None = None) -> DataFrame:
    """Questions still to do: without an answer, or whose answer was an error.

    Answers meet questions by id; those without an id, or of an unknown one, by text and kind, the n-th such answer the n-th
    such question, so that none counts twice.
    """
    done = answers.where(~F.coalesce(F.col("error"), F.lit(False)))
    left = questions.join(done.select(key).distinct(), key, "left_anti")
    if text is None or kind is None:
        return left
    nth = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(text, kind).orderBy(order)))
    loose = done.join(questions.select(key).distinct(), key, "left_anti")
    hit = nth(loose, F.col(key).asc_nulls_last()).select(F.col(text).alias("__t"), F.col(kind).alias("__d"), "__n")
    left = nth(left, F.col(key))
    same = left[text].eqNullSafe(hit["__t"]) & left[kind].eqNullSafe(hit["__d"]) & (left["__n"] == hit["__n"])
    return left.join(hit, same, "left_anti").drop("__n")


def read_store(spark: SparkSession, path: str, names: list[str], cache: bool = False) -> dict[str, DataFrame]:
    """The tables of a store; a snapshot's version is the newest change of any of its files, so a cached one is told from
    what was written later."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{path}/{n}")
        out[n] = df.persist() if cache else df
    return out


def store_version(store: DataFrame) -> DataFrame:
    """(files, newest, bytes): what tells one state of a stored table from another."""
    files = store.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.max("file_modification_time").alias("newest"), F.sum("file_size").alias("bytes"))
