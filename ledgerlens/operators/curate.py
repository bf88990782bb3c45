"""Curation of training records: splits, gates, mixes, pairings, chat records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from .retrieval import ranked


def stable_hash(key: Column, modulus: int = 1_000_000) -> Column:
    """sha1 of the key as an integer, modulo (below two billion): its hex digits are folded, ten at a time, as the whole
    number matters."""
    digits, out = F.sha1(key), F.lit(0).cast("long")
    for at in range(1, 40, 10):
        out = (out * (16**10 % modulus) + F.conv(F.substring(digits, at, 10), 16, 10).cast("long")) % modulus
    return out


def split(key: Column, salt: str, test: float = 0.1, dev: float = 0.1) -> Column:
    """test, dev or train, the same for a key on every run."""
    h = stable_hash(F.concat(F.lit(f"{salt}::"), key))
    return F.when(h < int(test * 1_000_000), "test").when(h < int((test + dev) * 1_000_000), "dev").otherwise("train")


def stable_sample(rows: DataFrame, by: list[str], key: Column, most: int, salt: str = "") -> DataFrame:
    """The first `most` rows of each group in the order of a salted hash; the sample is the feature."""
    return ranked(rows.withColumn("__h", F.sha2(F.concat(F.lit(salt), key), 256)), by, F.col("__h"), top=most, name="pick").drop("__h")


def mix(rows: DataFrame, group: str, key: str, quota: int, salt: str = "mix") -> DataFrame:
    """Up to `quota` rows of every group in hash order; a key that several groups hold goes to the first group alone."""
    first = ranked(rows, [key], F.col(group), top=1, name="__k").drop("__k")
    return stable_sample(first, [group], F.col(key).cast("string"), quota, salt)


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """`turn` (from 1) of every row in its group, and its `place` (from 1) when groups take turns in the order of their names.

    A place is a row's number in order of turn and group. Turns are numbered range by range of `order`: ranges come from
    approximate quantiles, their sizes are counted, so no group is numbered in one task; places are numbered by ranges of
    (turn, group) in the same way, with one count per task on the driver.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    at = F.lit(0)
    for i, c in enumerate(cuts):
        at = F.when(F.col(order) > c, i + 1).otherwise(at)
    rows = rows.withColumn("__range", at)
    sizes = rows.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    turn = F.row_number().over(Window.partitionBy(group, "__range").orderBy(order)) + F.col("__before")
    rows = rows.join(before.withColumnRenamed(group, "__g"), (F.col(group).eqNullSafe(F.col("__g"))) & (rows["__range"] == before["__range"])).drop(before["__range"]).withColumn("turn", turn)
    rows = rows.drop("__range", "__g", "__before").repartitionByRange("turn", group).sortWithinPartitions("turn", group)
    rows = cut(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted(tuple(r) for r in rows.groupBy("__part").count().collect())
    first = [(part, sum(n for p, n in counts if p < part)) for part, _ in counts]
    offset = spark.createDataFrame(first, "__part int, __first long")
    return rows.join(F.broadcast(offset), "__part").withColumn("place", F.col("__first") + F.col("__at") + 1).drop("__part", "__at", "__first")


def rotated_take(rows: DataFrame, by: list[str], order: str, start: Column, most: int) -> DataFrame:
    """`most` rows of every group, from a start that a hash chose, going round."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("turn", F.pmod(at - start % n, n)).where(F.col("turn") < most)


def pair_up(rows: DataFrame, by: list[str], order: list[str], item: str, again: list[str] | None = None) -> DataFrame:
    """(first, second, level): neighbours in order become pairs; those left over of each group are paired again within the
    coarser groups `again`; what is left then has no partner."""
    def paired(df: DataFrame, keys: list[str], level: int) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy(*keys)
        df = df.withColumn("__at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
        alone = (F.col("__n") % 2 == 1) & (F.col("__at") == F.col("__n") - 1)
        both = df.where(~alone).withColumn("pair", F.floor(F.col("__at") / 2)).groupBy(*keys, "pair")
        first = F.min_by(item, "__at").alias("first")
        return both.agg(first, F.max_by(item, "__at").alias("second")).withColumn("level", F.lit(level)), df.where(alone).drop("__at", "__n")

    pairs, rest = paired(rows, by, 0)
    if again is None:
        return pairs
    more, _ = paired(rest, again, 1)
    return pairs.unionByName(more, allowMissingColumns=True)


def quality_gate(rows: DataFrame, by: str, positives: int = 1, negatives: int = 3) -> DataFrame:
    """Rows of the questions that have enough positive and negative labels."""
    good = rows.groupBy(by).agg(F.count_if(F.col("label") == 2).alias("p"), F.count_if(F.col("label") == 0).alias("n")).where((F.col("p") >= positives) & (F.col("n") >= negatives))
    return rows.join(good.select(by), by, "left_semi")


def dedupe(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of every key."""
    named = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    names = [f"__k{i}" for i in range(len(keys))]
    return ranked(named, names, F.col(order), top=1, name="__n").drop("__n", *names)


def holdout(rows: DataFrame, texts: DataFrame, key: str, names: list[str], text: str = "text") -> DataFrame:
    """Rows none of whose names (such as a company's name and code) stands in any text, inside longer words too."""
    from .routing import alias_matches

    every = rows.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])))).alias("alias"))
    ids = texts.select(F.xxhash64(text).alias("__id"), F.col(text).alias("text")).where("text is not null").dropDuplicates(["__id"])
    found = alias_matches(ids, every.select("alias").distinct(), "__id", fold=False).select("alias").distinct()
    return rows.join(every.join(found, "alias").select(key).distinct(), key, "left_anti")


def chat_record(rows: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """One JSON list of messages per conversation."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct(order, role, text))), lambda m: F.struct(m[role].alias("role"), m[text].alias("content")))
    return rows.groupBy(by).agg(F.to_json(turns).alias("messages"), F.count(F.lit(1)).alias("n_messages"))


def accept(rows: DataFrame, **reject: Column) -> DataFrame:
    """Adds the reason of the first gate that a row fails, null if it passes all."""
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reject.items()])
    return rows.withColumn("reason", why)


def dominant_share(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most common value of each group and its share."""
    count = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = count.groupBy(*by).agg(F.sum("n").alias("total"))
    return ranked(count, by, F.col("n").desc(), F.col(value), top=1).drop("rank").join(total, by).withColumn("share", F.round(F.col("n") / F.col("total"), 4))


#: Shares of one question text, and of one target by kind, beyond which a catalog is out of balance (fixed values).
TEXT_SHARE, TARGET_SHARES = 0.12, {"name": 0.40, "boolean": 0.45, "number": 0.35}


def imbalance_warnings(records: DataFrame) -> DataFrame:
    """(warning_type, schema, value, n, share): the most common question text and target of each kind where it is too common.
    records: schema, question_text, target_key."""
    text = dominant_share(records, ["schema"], "question_text").where(F.col("share") > TEXT_SHARE).select(F.lit("question_text_dominance").alias("warning_type"), "schema", F.col("question_text").alias("value"), "n", "share")
    limit = F.lit(None).cast("double")
    for kind, most in TARGET_SHARES.items():
        limit = F.when(F.col("schema") == kind, most).otherwise(limit)
    target = dominant_share(records.where(F.col("target_key").isNotNull()), ["schema"], "target_key").where(F.col("share") > limit)
    return text.unionByName(target.select(F.lit("target_key_imbalance").alias("warning_type"), "schema", F.col("target_key").alias("value"), "n", "share"))


def bucket_entries(docs: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """(year, industry, tag, board, n, docs): distinct documents per year, industry and tag where there are `least` to `most`;
    where there are more, per board under the same bounds. docs: doc, year, industry, board, tags (array)."""
    known = docs.where(F.col("year").isNotNull() & (F.col("year") != 0) & (F.trim("industry") != "") & F.col("doc").isNotNull())
    rows = known.select("doc", "year", F.trim("industry").alias("industry"), F.nullif(F.trim("board"), F.lit("")).alias("board"), F.explode("tags").alias("tag")).where("trim(tag) <> ''").distinct()
    size = rows.groupBy("year", "industry", "tag").agg(F.countDistinct("doc").alias("n"))
    of_board = rows.where("board is not null").groupBy("year", "industry", "tag", "board").agg(F.countDistinct("doc").alias("n"))
    keys = ["year", "industry", "tag"]
    whole = size.where(F.col("n").between(least, most)).withColumn("board", F.lit(None).cast("string"))
    parts = of_board.where(F.col("n").between(least, most)).join(size.where(F.col("n") > most).select(*keys), keys, "left_semi")
    chosen = whole.unionByName(parts)
    # lists hold `most` documents at the most
    hit = chosen.alias("c").join(rows.alias("r"), (F.col("c.year") == F.col("r.year")) & (F.col("c.industry") == F.col("r.industry")) & (F.col("c.tag") == F.col("r.tag")) & (F.col("c.board").isNull() | (F.col("c.board") == F.col("r.board"))))
    return hit.groupBy("c.year", "c.industry", "c.tag", "c.board", "c.n").agg(F.array_sort(F.collect_set("r.doc")).alias("docs"))


def surface_form(forms: list[str], key: Column, salt: str, **context: Column) -> Column:
    """One of the forms whose placeholders ("{name}") are all known, by a stable hash of the key, rendered. Of up to 16 forms
    the whole hash's remainder chooses, which the hash modulo 720720 shares."""
    rendered = []
    for i, form in enumerate(forms):
        out, known = F.lit(form), F.lit(True)
        for name, value in context.items():
            if "{" + name + "}" in form:
                out, known = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(""))), known & F.coalesce(value.cast("string") != "", F.lit(False))
        open_names = [n for n in re.findall(r"{(\w+)}", form) if n not in context]
        rendered.append(F.when(known & F.lit(not open_names), F.struct(F.lit(f"{i:02d}").alias("variant"), out.alias("text"))))
    good = F.array_compact(F.array(*rendered))
    return F.get(good, F.pmod(stable_hash(F.concat(F.lit(f"{salt}::"), key), 720_720), F.greatest(F.size(good), F.lit(1))).cast("int"))


def parity_split(group: Column, slot: Column) -> Column:
    """dev or test by a group's number and the slot within it: odd slots of odd groups and even ones of even groups are dev."""
    return F.when(F.when(group % 2 == 1, slot.isin(1, 3, 5)).otherwise(slot.isin(2, 4, 6)), "dev").otherwise("test")


def overlap_of_splits(rows: DataFrame, split_column: str, key: str) -> DataFrame:
    """Keys that stand in more than one split, with the splits: empty if the splits are disjoint."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split_column)), ",").alias("splits"), F.countDistinct(split_column).alias("n")).where("n > 1")
