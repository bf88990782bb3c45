"""Benchmark decontamination: template canonicalisation catches quoted and re-parameterised questions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, fresh, stash, text_of

#: Tokens of a template window; share of an item's windows that must be found near one place of a document; tokens by
#: which they may shift against that place; tokens of the shortest item that is sought inside texts; every which window of
#: a text is looked up.
WINDOW, COVER, SHIFT, SHORTEST, STRIDE = 8, 0.8, 2, 4, 3
#: What counts as a unit after a number (fixed values): SI and everyday units, currencies, times.
UNITS = "km m cm mm kg g mg l ml s ms h hr hrs min mins hour hours minute minutes second seconds day days week weeks month months year years mile miles foot feet inch inches meter meters metre metres liter liters litre litres gram grams pound pounds dollar dollars euro euros cent cents usd eur gbp percent kmh mph".split()
#: Signs around a slot's kind and value, and before a placeholder; they are taken out of texts first.
OPEN, CLOSE, SLOT = "\x02", "\x03", "\x01"
#: Numbers with a unit after them, other numbers, and runs of capitalised words.
GAP = r"[^\p{L}\p{M}\d.!?\n\x01-\x03]"
WITH_UNIT = rf"(?i)(\d++(?:[.,]\d++)*+)({GAP}{{0,3}})((?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}\d]))"
NUMBER = r"\d++(?:[.,]\d++)*+(?![\x03])"
NAMES = rf"(?<![\p{{L}}\p{{M}}])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*+(?:{GAP}++\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*+)*+"
MARKED, TOKEN = r"\x02(.)[^\x03]*+\x03", r"\x02[^\x03]*\x03|[\p{L}\p{M}]+"
OUT = ("contaminated", "items")


def _marked(text):
    """Texts with numbers and units marked, and with runs of capitalised words marked too: (literal, typed)."""
    clean = F.when(text.rlike("[\x01-\x03]"), F.translate(text, SLOT + OPEN + CLOSE, "   ")).otherwise(text)
    literal = F.regexp_replace(F.regexp_replace(clean, WITH_UNIT, f"{OPEN}n$1{CLOSE} {OPEN}u$3{CLOSE}"), NUMBER, f"{OPEN}n$0{CLOSE}")
    return literal, F.regexp_replace(literal, NAMES, f"{OPEN}p$0{CLOSE}")


def _template(marked):
    """Template tokens, each followed by a space: a slot is its placeholder, any other word is itself in lower case."""
    flat = F.regexp_replace(F.lower(F.regexp_replace(marked, MARKED, f" {SLOT}$1 ")), r"[^\p{L}\p{M}\x01]+", " ")
    return F.concat(F.ltrim(flat), F.when(flat.endswith(" "), F.lit("")).otherwise(F.lit(" ")))


def _windows(template, size: int, stride: int):
    """Runs of `size` template tokens, in order, every `stride` tokens."""
    return F.regexp_extract_all(template, F.lit(rf"(?=((?:[^ ]++ ){{{size}}}))(?:[^ ]++ ){{{stride}}}"), F.lit(1))


def window_size(n: int, window: int = WINDOW, cover: float = COVER) -> tuple[int, int]:
    """(size, stride) of windows for an item of n tokens.

    With every STRIDE-th window of a text looked up, some are met wherever the item stands: of its W windows those at every
    STRIDE-th place are W // STRIDE at least, and at most the share 1 - cover of W may be missing. The size is the largest
    for which the first number is greater. Items shorter than a window are one window, looked up at every place.
    """
    if n < window:
        return n, 1
    for size in range(window, 0, -1):
        w = n - size + 1
        if w // STRIDE > w - math.ceil(w * cover - 1e-9):
            return size, STRIDE
    return n, 1


def templates(table: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, template, marked) of every text, twice: kind 0 with names as slots, kind 1 with names as words."""
    literal, typed = _marked(F.col("text"))
    rows = table.select(*key, literal.alias("literal"), typed.alias("typed"))
    rows = rows.select(*key, F.posexplode(F.array("typed", "literal")).alias("kind", "marked"))
    return rows.select(*key, "kind", _template(F.col("marked")).alias("template"), "marked")


def _values(marked):
    """What every template token stands for, in lower case: a slot's value or the word."""
    return F.transform(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(F.when(t.startswith(OPEN), F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(t)))


def _items(benchmark: DataFrame, window: int, cover: float) -> DataFrame:
    """(item_id, kind, tokens, values, size, stride, of_windows) of items that hold a token."""
    rows = templates(benchmark.select("item_id", text_of().alias("text")).where("item_id is not null").dropDuplicates(["item_id", "text"]), ["item_id"])
    rows = rows.select("item_id", "kind", "template", F.split(F.rtrim("template"), " ").alias("tokens"), _values(F.col("marked")).alias("values")).where(F.trim("template") != "")
    size, stride = F.lit(window), F.lit(STRIDE)
    for n in range(1, 3 * window):  # longer items have windows of the full size
        k, m = window_size(n, window, cover)
        size, stride = F.when(F.size("tokens") == n, k).otherwise(size), F.when(F.size("tokens") == n, m).otherwise(stride)
    rows = rows.withColumn("size", size).withColumn("stride", stride)
    return rows.withColumn("of_windows", F.size("tokens") - F.col("size") + 1)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, shift: int = SHIFT) -> DataFrame:
    """(doc_id, key, item_id, kind, place, windows, of_windows, changed): item_id's template stands in the document.

    Both sides become templates: numbers, units after them and runs of capitalised words are typed placeholders, all else
    is the word in lower case; what a token is does not depend on what stands before it in the sentence. A second template
    takes names as words, for texts in other case. Items are sought by either.

    At least `cover` of an item's windows must be found near one place (the item's first token in the document), each
    shifted by `shift` tokens at most. Of a text every STRIDE-th window is looked up, one pass a size. Of the item's
    windows at places of one remainder at most floor((1 - cover) * windows) are missing, so of any one more than that one is
    found: those that the fewest items share are the keys, for every remainder. What every item begins with is no key of
    any. This is exact where an item stands unshifted; a shifted one is met unless all its keys fall between the looks. Only
    documents with a key are read again.

    A pair stands if the slots agree: every value of the item's slots turns into one value throughout, and different values
    stay different. At the item's ends a name may be longer in the document. changed counts the slots whose value differs:
    0 is a quotation, more a re-parameterised question.

    Items of fewer than SHORTEST tokens are too short to be told from chance inside a text: they are found in texts that
    hold nothing else. Native: DataFrame functions only.
    """
    spark = docs.sparkSession
    items, items_path = stash(_items(benchmark, window, cover), "items")
    need = F.ceil(F.col("of_windows") * cover - 1e-9)
    # the keys of every item and kind, and the sizes of windows (window - SHORTEST values besides its own at most)
    parts = items.where(F.col("size") >= SHORTEST).select("item_id", "kind", "tokens", "size", "stride", "of_windows", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("of_windows") - 1), lambda i: F.concat(F.array_join(F.slice("tokens", i + 1, F.col("size")), " "), F.lit(" ")))).alias("at", "run"))
    shared = parts.groupBy("kind", "run").agg(F.countDistinct("item_id").alias("n"))
    rare = Window.partitionBy("item_id", "kind", "tokens", F.col("at") % F.col("stride")).orderBy("n", "at")
    keys = parts.join(shared, ["kind", "run"]).withColumn("k", F.row_number().over(rare)).where(F.col("k") <= F.col("of_windows") - need + 1)
    looks, looks_path = stash(keys.select(F.xxhash64("kind", "run").alias("h"), "item_id", "kind", "at", F.size("tokens").alias("n_tokens")), "looks")
    sizes = sorted({(window, STRIDE)} | {(r["size"], r["stride"]) for r in items.where(F.col("size") >= SHORTEST).select("size", "stride").distinct().collect()})
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("text"))
    found = templates(texts, ["doc_id", "key"])
    looked = None
    for n, m in sizes:  # one size where all items are long; the templates of a text are worked out once for each
        part = found.select("doc_id", "key", "kind", F.posexplode(_windows(F.col("template"), n, m)).alias("pos", "run"))
        part = part.select("doc_id", "key", "kind", (F.col("pos") * m).alias("pos"), F.xxhash64("kind", "run").alias("h"))
        looked = part if looked is None else looked.unionByName(part)
    hits = looked.join(looks.drop("kind"), "h").select("doc_id", "key", "kind", "item_id", "n_tokens", (F.col("pos") - F.col("at")).alias("place"))
    short = items.where(F.col("size") < SHORTEST).select(F.xxhash64("kind", "template").alias("h"), "item_id", F.size("tokens").alias("n_tokens"))
    if not short.isEmpty():
        whole = found.where(~F.col("template").rlike(rf"^(?:[^ ]+ ){{{SHORTEST}}}")).withColumn("h", F.xxhash64("kind", "template"))
        hits = hits.unionByName(whole.join(short, "h").select("doc_id", "key", "kind", "item_id", "n_tokens", F.lit(0).alias("place")))
    cand, cand_path = stash(hits.distinct(), "candidates")
    # documents that hold a key are tokenised again; of each only what lies around its places moves on
    places = cand.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("kind", "item_id", "n_tokens", "place")).alias("places"))
    places, places_path = stash(places, "places")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    left = texts.join(places, same).dropDuplicates(["doc_id", "key"])
    literal, typed = _marked(F.col("text"))
    left = left.select("doc_id", "key", "places", typed.alias("m0"), literal.alias("m1"))
    for i in (0, 1):
        left = left.withColumn(f"t{i}", F.split(F.rtrim(_template(F.col(f"m{i}"))), " ")).withColumn(f"v{i}", _values(F.col(f"m{i}")))
    one = left.select("doc_id", "key", "t0", "t1", "v0", "v1", F.explode("places").alias("p"))
    low = F.greatest(F.col("p.place") - shift, F.lit(0))
    around = lambda c: F.slice(F.when(F.col("p.kind") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")), low + 1, F.col("p.n_tokens") + 2 * shift)
    one = one.select("doc_id", "key", "p.item_id", "p.kind", "p.place", (F.col("p.place") - low).alias("lead"), around("t").alias("have"), around("v").alias("said"))
    both, both_path = stash(one.join(items.drop("template"), ["item_id", "kind"]), "both")
    # per window of the item the nearest place, within the shift, where the same tokens stand
    at_place = lambda i, s: F.slice("have", F.greatest(i + F.col("lead") + s + 1, F.lit(1)), F.col("size"))
    order = F.array(*[F.lit(s) for k in range(shift + 1) for s in ((0,) if k == 0 else (-k, k))])
    fits = lambda i, s: (i + F.col("lead") + s >= 0) & (at_place(i, s) == F.slice("tokens", i + 1, F.col("size")))
    nearest = F.transform(F.sequence(F.lit(0), F.col("of_windows") - 1), lambda i: F.struct(i.alias("i"), F.get(F.filter(order, lambda s: fits(i, s)), F.lit(0)).alias("s")))
    both = both.withColumn("met", F.filter(nearest, lambda x: x["s"].isNotNull())).where(F.size("met") >= need)
    both, met_path = stash(both, "met")
    # (kind, the item's value, the document's) of every slot under a window that was found
    def slot(x, k):
        at, here = x["i"] + k, x["i"] + k + F.col("lead") + x["s"]
        mine, other = F.get("values", at), F.get("said", here)
        first = (at == 0) & other.endswith(F.concat(F.lit(" "), mine))
        last = (at == F.size("tokens") - 1) & other.startswith(F.concat(mine, F.lit(" ")))
        return F.struct(F.get("tokens", at).alias("kind"), mine.alias("a"), F.when(first | last, mine).otherwise(other).alias("b"))

    pairs = F.flatten(F.transform("met", lambda x: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: slot(x, k))))
    both = both.withColumn("pairs", F.array_distinct(F.filter(pairs, lambda p: p["kind"].startswith(SLOT))))
    apart = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p[f]))))
    both = both.where((apart("a") == F.size("pairs")) & (apart("b") == F.size("pairs")))
    changed = F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))
    out = both.select("doc_id", "key", "item_id", "kind", "place", F.size("met").alias("windows"), "of_windows", changed.alias("changed"))
    for path in (looks_path, cand_path, places_path, both_path, items_path):
        drop_stash(spark, path)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """docs without the documents that hold a benchmark item, with all their columns.

    Defined results: null and empty texts hold nothing and stay; null item texts match nothing; an item's repeats count like
    one; rows that repeat a doc_id are judged each by their own text; null doc_ids are judged like others; an empty benchmark
    keeps everything; an empty table gives an empty table; columns of any name pass through.
    """
    key, d, k = fresh(docs, "key", "bad_doc", "bad_key")
    bad = contaminated_pairs(docs, benchmark, window, cover).select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct()
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontamination(spark, sf_dir):
    """One row per contaminated document and item: where it begins, how much of it was found, how many slots changed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.col("windows").desc(), "changed", "kind", "place")))
    return best.where("n = 1").select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("place", "windows", "of_windows", "changed")])


#: The same rows for tables whose items have at least SHORTEST tokens and whose ids don't repeat. RE2 knows no look-around:
#: texts are cut into words, numbers and what is between; a name goes on over what holds no sign that ends a sentence.
OP7_SQL = rf"""
WITH t AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '   '), '\d+(?:[.,]\d+)*|[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}\d]+') AS tk
  FROM (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
), e AS (
  SELECT side, id, generate_subscripts(tk, 1) AS i, unnest(tk) AS t FROM t
), w AS (
  SELECT *, regexp_matches(t, '^[\p{{L}}\p{{M}}\d]') AS word, lag(t) OVER o AS b1, lag(t, 2) OVER o AS b2, lead(t) OVER o AS a1 FROM e WINDOW o AS (PARTITION BY side, id ORDER BY i)
), s AS (
  SELECT *, CASE WHEN regexp_matches(t, '^\d') THEN chr(1) || 'n'
    WHEN regexp_full_match(lower(t), '{"|".join(UNITS)}') AND NOT coalesce(regexp_matches(a1, '^\d'), false)
      AND (coalesce(regexp_matches(b1, '^\d'), false) OR (coalesce(regexp_matches(b2, '^\d'), false) AND regexp_full_match(b1, '[^.!?\n\p{{L}}\p{{M}}\d]{{1,3}}'))) THEN chr(1) || 'u'
    WHEN regexp_matches(t, '^\p{{Lu}}\p{{Ll}}') THEN chr(1) || 'p' ELSE lower(t) END AS kind FROM w
), n AS (
  SELECT *, coalesce(kind = chr(1) || 'p' AND lag(kind, 2) OVER o = chr(1) || 'p' AND regexp_full_match(b1, '[^.!?\n\p{{L}}\p{{M}}\d]+'), false) AS goes_on FROM s WINDOW o AS (PARTITION BY side, id ORDER BY i)
), g AS (
  SELECT *, sum(CASE WHEN word AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY side, id ORDER BY i) AS run FROM n
), f AS (
  SELECT side, id, 0 AS kind, run AS nth, any_value(kind) AS k, lower(string_agg(CASE WHEN goes_on THEN b1 || t ELSE t END, '' ORDER BY i)) AS v FROM g WHERE word GROUP BY side, id, run
  UNION ALL SELECT side, id, 1, i, CASE WHEN kind = chr(1) || 'p' THEN lower(t) ELSE kind END, lower(t) FROM s WHERE word
), l AS (
  SELECT side, id, kind, list(k ORDER BY nth) AS ks, list(v ORDER BY nth) AS vs, len(list(k)) AS n FROM f GROUP BY side, id, kind
), b AS (
  SELECT id, kind, ks, vs, n, CASE {" ".join(f"WHEN n = {n} THEN {window_size(n)[0]}" for n in range(1, 3 * WINDOW))} ELSE {WINDOW} END AS size, CASE {" ".join(f"WHEN n = {n} THEN {window_size(n)[1]}" for n in range(1, 3 * WINDOW))} ELSE {STRIDE} END AS stride FROM l WHERE side = 'b'
), bw AS (
  SELECT *, array_to_string(ks[p + 1 : p + size], ' ') AS win FROM (SELECT *, n - size + 1 AS total, unnest(range(0, n - size + 1)) AS p FROM b)
), sh AS (
  SELECT kind, win, count(DISTINCT id) AS items FROM bw GROUP BY kind, win
), ky AS (
  SELECT * FROM (SELECT bw.*, row_number() OVER (PARTITION BY id, bw.kind, p % stride ORDER BY items, p) AS r FROM bw JOIN sh ON sh.kind = bw.kind AND sh.win = bw.win) WHERE r <= total - ceil(total * {COVER} - 1e-9) + 1
), z AS (
  SELECT DISTINCT size, stride FROM b
), dw AS (
  SELECT id, kind, size, p, array_to_string(ks[p + 1 : p + size], ' ') AS win FROM (SELECT l.*, z.size, unnest(range(0, n - z.size + 1, z.stride)) AS p FROM l, z WHERE side = 'd')
), c AS (
  SELECT DISTINCT dw.id AS doc_id, ky.id AS item_id, dw.kind, dw.p - ky.p AS place FROM dw JOIN ky ON dw.kind = ky.kind AND dw.size = ky.size AND dw.win = ky.win
), m AS (
  SELECT c.*, b.ks, b.vs, b.n, b.size, b.n - b.size + 1 AS total, l.ks AS dk, l.vs AS dv FROM c JOIN b ON b.id = item_id AND b.kind = c.kind JOIN l ON l.side = 'd' AND l.id = doc_id AND l.kind = c.kind
), x AS (
  SELECT *, list_filter([0, -1, 1, -2, 2], lambda d: place + p + d >= 0 AND dk[place + p + d + 1 : place + p + d + size] = ks[p + 1 : p + size])[1] AS d FROM (SELECT *, unnest(range(0, total)) AS p FROM m)
), y AS (
  SELECT doc_id, item_id, kind, place, count(*) AS windows, any_value(total) AS of_windows FROM x WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= any_value(total) * {COVER} - 1e-9
), q AS (
  SELECT DISTINCT doc_id, item_id, kind, place, ks[p + j + 1] AS k, vs[p + j + 1] AS a,
    CASE WHEN (p + j = 0 AND ends_with(dv[place + p + d + j + 1], ' ' || vs[p + j + 1])) OR (p + j = n - 1 AND starts_with(dv[place + p + d + j + 1], vs[p + j + 1] || ' ')) THEN vs[p + j + 1] ELSE dv[place + p + d + j + 1] END AS b
  FROM (SELECT *, unnest(range(0, size)) AS j FROM x WHERE d IS NOT NULL) WHERE ks[p + j + 1][1] = chr(1)
), o AS (
  SELECT doc_id, item_id, kind, place, count(*) AS n, count(DISTINCT (k, a)) AS na, count(DISTINCT (k, b)) AS nb, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS changed FROM q GROUP BY 1, 2, 3, 4
), r AS (
  SELECT y.*, coalesce(changed, 0) AS changed, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY windows DESC, coalesce(changed, 0), kind, place) AS rk FROM y LEFT JOIN o USING (doc_id, item_id, kind, place) WHERE coalesce(n = na AND n = nb, true)
)
SELECT doc_id, item_id, CAST(place AS BIGINT) AS place, windows, of_windows, CAST(changed AS BIGINT) AS changed FROM r WHERE rk = 1
"""
