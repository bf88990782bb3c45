"""Text primitives as column expressions: normalisation, tokens, numbers, periods, codes, n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters that the compatibility normal form leaves as they are; only texts that hold another go to Python.
STABLE = r"^[\x00-\x9F¡-§©«¬®°±¶·»¿À-ÿ一-鿿、。‘’“”–—]*$"
#: Wide forms of ASCII signs and the wide space, each of which becomes one plain character, and texts that hold nothing else but those.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
STABLE_OR_WIDE = STABLE.replace("]*$", r"\uFF01-\uFF5E\u3000]*$")
#: White space beyond what \s means to the JVM.
SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2028\u2029]+"


#: Bytes of texts that a task turns into Python objects at a time.
PART = 2 << 20


def in_parts(batches: Iterable[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of about `most` (PART) bytes of one text column, or of one row: however much Spark hands
    over at once, no more than a part becomes Python objects."""
    most = most or PART
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def nfkc(text: Column) -> Column:
    """Compatibility normal form; Spark has no built-in for it. Texts that it can't change, and those of which it only makes
    wide signs plain ones, stay in the JVM."""

    @F.arrow_udf(StringType())
    def form(part: pa.Array) -> pa.Array:
        if part.null_count == len(part):
            return part
        parts = in_parts([pa.record_batch([part], ["text"])], 0)
        return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in p.column(0).to_pylist()], pa.string()) for p in parts])

    narrow = F.when(text.rlike(r"[\uFF01-\uFF5E\u3000]"), F.translate(text, WIDE, NARROW)).otherwise(text)
    return F.coalesce(form(F.when(~text.rlike(STABLE_OR_WIDE), text)), narrow)


def without_commas(text: Column) -> Column:
    """No commas between digits."""
    return F.regexp_replace(text, r"(?<=\d)[,，](?=\d)", "")


def normalize_text(text: Column, exact: bool = True) -> Column:
    """NFKC, folded dashes, quotes, brackets and colons, no commas inside numbers, lower case, spaced percent signs, single
    spaces; null counts as empty."""
    out = F.coalesce(nfkc(text) if exact else text, F.lit(""))
    out = F.translate(out, "\u00a0’–—（）：；，", " '--():;,")
    out = F.replace(F.lower(without_commas(out)), F.lit("%"), F.lit(" % "))
    return F.trim(F.regexp_replace(out, SPACE, " "))


def squeezed(text: Column, exact: bool = True) -> Column:
    """normalize_text() without any space: the form in which table text is searched."""
    return F.replace(normalize_text(text, exact), F.lit(" "), F.lit(""))


#: Signs of the radical block that scanners return, and the characters that they stand for.
RADICALS, PLAIN = "⼈⼊⾏⾦⽀⼆⼀", "人入行金支二一"


def table_text(text: Column, exact: bool = True) -> Column:
    """squeezed() after radicals became the characters they stand for."""
    return squeezed(F.translate(text, RADICALS, PLAIN), exact)


def compact_text(text: Column) -> Column:
    """Lower case without white space or punctuation: the form in which names are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def tokens(text: Column) -> Column:
    """Words and numbers in lower case, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Terms of finance that are index tokens of their own.
FINANCE_TERMS = ("营业收入", "营收", "归母净利润", "扣非归母净利润", "毛利率", "净利率", "期间费用率", "经营活动现金流净额", "资产负债率", "每股收益", "分红", "回购", "并购", "定增", "券商", "年报", "研报")
#: What an index token of Latin letters and digits is, and a run of ideographs.
LATIN, IDEOGRAPHS = r"[a-z0-9]+(?:[./_-][a-z0-9]+)?", r"[一-鿿]+"


def index_tokens(text: Column, exact: bool = True) -> Column:
    """Distinct index tokens of the normalised text, in order: Latin words and numbers; of a run of ideographs the run, its
    bigrams if it has more than two, and the finance terms that it holds."""
    text = normalize_text(text, exact)
    latin = F.regexp_extract_all(text, F.lit(LATIN), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(IDEOGRAPHS), F.lit(0))
    terms = F.array(*map(F.lit, FINANCE_TERMS))
    of_run = lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(F.concat(F.array(r), char_ngrams(r, 2), F.filter(terms, lambda t: F.contains(r, t))))
    # most texts hold no ideograph: the second part is not even looked at
    return F.when(text.rlike(IDEOGRAPHS), F.array_distinct(F.concat(latin, F.flatten(F.transform(runs, of_run))))).otherwise(F.array_distinct(latin))


def char_ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order, by one pass of a look-ahead; a text no longer than n is one, an empty one none."""
    many = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) > n, many).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[一-鿿]"), F.lit(False))


def clean_scalar(value: Column) -> Column:
    """Trimmed text, null for what is empty."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_present(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[clean_scalar(v) for v in values])


def to_int(value: Column) -> Column:
    """The whole number that a text is; null for anything else."""
    flat = F.trim(value.cast("string"))
    return F.when(flat.rlike(r"^[+-]?\d+$"), flat.try_cast("int"))


def to_list(values: Column) -> Column:
    """Distinct trimmed items of an array in order; null and empty ones are left out, a null array has none."""
    clean = F.transform(values, lambda x: clean_scalar(x))
    return F.coalesce(F.array_distinct(F.array_compact(clean)), F.array().cast("array<string>"))


#: Exchange names that may stand beside a code of six digits, and the digits that begin one.
_EXCHANGE, _CODE = "(?:SH|SZ|SSE|SZSE|BJ|BSE)", r"[03468]\d{5}"


def security_codes(text: Column, exact: bool = True) -> Column:
    """Distinct six-digit codes in order of appearance, exchange affixes left out."""
    text = F.coalesce(nfkc(text) if exact else text, F.lit(""))
    whole = rf"(?i)(?<![A-Z0-9])(?:{_EXCHANGE}[\s:._-]?{_CODE}|{_CODE}[\s:._-]?{_EXCHANGE}|{_CODE})(?![A-Z0-9])"
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_extract(t, _CODE, 0)))


#: Multipliers by unit.
UNIT_FACTORS = {
    "亿股": 1e8, "亿元": 1e8, "亿港元": 1e8, "亿美元": 1e8, "亿人民币": 1e8, "千万": 1e7, "百万": 1e6, "万股": 1e4, "万元": 1e4, "万港元": 1e4, "万美元": 1e4, "万元人民币": 1e4,
    "千元": 1e3, "百万元": 1e6, "千万元": 1e7,
}
#: Units that a chunk's text is searched for, the first one found counts.
CHUNK_UNITS = ("亿元", "万元", "亿股", "万股", "百万元", "千万元", "%", "百分点")


def first_held(text: Column, names) -> Column:
    """The first of the names, in their order, that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names])


def unit_hint(text: Column) -> Column:
    """The unit that a chunk's text names."""
    return first_held(text, CHUNK_UNITS)


def first_number(plain: Column) -> Column:
    """First number of a text without commas between digits, with its sign as for parse_numeric(); null without one."""
    value = F.nullif(F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    return F.when(plain.rlike(r"^\s*[(\-]|[(\-]\s*\d") & (value > 0), -value).otherwise(value)


def parse_numeric(text: Column, hint: Column | None = None, exact: bool = True) -> Column:
    """First number with its sign, times the factor of the longest unit that the text or the hint names, of equally long ones
    the first of UNIT_FACTORS; a percentage keeps its number; null without a number.

    A minus sign or opening bracket right before any digit makes it negative, also in a range such as 12-15.
    """
    plain = without_commas(nfkc(text) if exact else text)
    value = first_number(plain)
    units = F.concat_ws(" ", plain, F.coalesce(hint, F.lit(""))) if hint is not None else plain
    # every unit begins with one of four signs; the longest counts, of equally long ones the first of the table; the text is worked out once, as a lambda's variable
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(UNIT_FACTORS[n]).alias("factor")) for n in sorted(UNIT_FACTORS, key=len, reverse=True)])
    of = lambda u: F.when(u.rlike("%|百分点") | ~u.rlike("[亿千百万]"), F.lit(1.0)).otherwise(F.coalesce(F.get(F.filter(known, lambda x: F.contains(u, x["name"])), F.lit(0))["factor"], F.lit(1.0)))
    return value * F.get(F.transform(F.array(units), of), F.lit(0))


#: Longer names of report kinds and their short forms, in the order in which they are replaced.
REPORT_WORDS = (("年度报告", "年报"), ("季度报告", "季报"), ("半年度报告", "半年报"))


def period_token(text: Column, exact: bool = True) -> Column:
    """First year 20xx that a quarter or the name of a report follows, with it, upper case and without spaces; else null."""
    flat = normalize_text(text, exact)
    for long, short in REPORT_WORDS:
        flat = F.replace(flat, F.lit(long), F.lit(short))
    found = F.regexp_extract(flat, r"20\d{2}\s*(?:q[1-4]|年报|半年报|中报|季报|一季报|三季报)", 0)
    return F.nullif(F.upper(F.replace(found, F.lit(" "), F.lit(""))), F.lit(""))


#: Currency codes by alias.
CURRENCIES = {
    "$": "USD", "usd": "USD", "us$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP", "jpy": "JPY", "yen": "JPY", "cny": "CNY", "rmb": "CNY", "人民币": "CNY",
    "aud": "AUD", "cad": "CAD", "chf": "CHF", "港币": "HKD", "hkd": "HKD",
}


def currency_token(text: Column, exact: bool = True) -> Column:
    """Canonical currency code of an alias, else the text in upper case; null for what is empty."""
    flat = F.trim(nfkc(text) if exact else text)
    key, out = F.lower(flat), F.upper(flat)
    for name, code in CURRENCIES.items():
        out = F.when(key == name, F.lit(code)).otherwise(out)
    return F.when(text != "", out)


def section_segments(path: Column, *levels: Column) -> Column:
    """Segments of a path parted by ">", or else the levels that hold something."""
    split = F.filter(F.transform(F.split(path, ">"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(clean_scalar(path).isNotNull(), split).otherwise(F.array_compact(F.array(*[clean_scalar(x) for x in levels])) if levels else F.array().cast("array<string>"))


def flat_text(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def snippet(text: Column, most: int = 220) -> Column:
    """White space collapsed, cut to `most` characters with a mark where cut."""
    flat = flat_text(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)


def short_snippet(text: Column, most: int = 240) -> Column:
    """White space collapsed, cut so that with its mark it has `most` characters."""
    flat = flat_text(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def position_of(term: Column, text: Column) -> Column:
    """First place of a term, 1-based, 0 for none; plain ASCII terms are found in any case."""
    ascii_only = F.length(term) == F.octet_length(term)
    return F.when(ascii_only, F.position(F.lower(term), F.lower(text))).otherwise(F.position(term, text))


def snippet_around(term: Column, text: Column, before: int = 80, after: int = 140) -> Column:
    """What stands around the first place of a term, from `before` characters ahead of it to `after` past its end, flat."""
    at = position_of(term, text)
    low = F.greatest(at - 1 - before, F.lit(0))
    high = F.least(F.length(text), at - 1 + F.length(term) + after)
    return F.when(at > 0, flat_text(F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))))


def query_fingerprint(text: Column) -> Column:
    """What is left of a query without punctuation, spaces and case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other holds."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; edit distance is not the same measure. Two empty texts are alike."""

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else BitMatcher(p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


class BitMatcher(SequenceMatcher):
    """The standard library's matcher, with the longest match of two stretches found on whole bit matrices.

    A row per character of the first stretch has a bit for each equal character of the second, and a bit more, so that the next
    character of both is always one row and one bit on. Runs of twice a length are runs that a run of that length follows; the lowest bit of
    the longest is the match that begins first, which is the library's choice too. Small and very large stretches are left to the library.
    """

    #: Cells of a matrix below which, and bits above which, the library looks itself.
    SMALL, LARGE = 4000, 1 << 26

    def __init__(self, a: str, b: str):
        super().__init__(None, a, b)
        # popular characters of a long second text begin no match there, and so have no bits
        signs = sorted(self.b2j)
        self.equal = np.zeros((len(signs) + 1, len(b)), bool)  # the last row is for all other characters
        for k, s in enumerate(signs):
            self.equal[k, self.b2j[s]] = True
        if len(a) * len(b) >= self.SMALL and signs:
            known, said = (np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in (signs, a))
            at = np.minimum(np.searchsorted(known, said), len(known) - 1)
            self.row = np.where(known[at] == said, at, len(known))

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        wide = 8 * ((bhi - blo) // 8 + 1)
        if (ahi - alo) * (bhi - blo) < self.SMALL or (ahi - alo) * wide > self.LARGE or len(self.equal) == 1:
            return super().find_longest_match(alo, ahi, blo, bhi)
        rows = np.zeros((len(self.equal), wide), bool)
        rows[:, : bhi - blo] = self.equal[:, blo:bhi]
        runs = [int.from_bytes(np.packbits(rows, axis=1, bitorder="little")[self.row[alo:ahi]].tobytes(), "little")]  # of 1, 2, 4, ...
        i, j, size = alo, blo, 0
        if runs[0]:
            while more := runs[-1] & (runs[-1] >> ((wide + 1) << (len(runs) - 1))):
                runs.append(more)
            found, size = runs[-1], 1 << (len(runs) - 1)
            for k in range(len(runs) - 2, -1, -1):
                if more := found & (runs[k] >> ((wide + 1) * size)):
                    found, size = more, size + (1 << k)
            i, j = divmod((found & -found).bit_length() - 1, wide)
            i, j = alo + i, blo + j
        a, b = self.a, self.b
        while i > alo and j > blo and a[i - 1] == b[j - 1]:  # by popular characters, as the library does
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return Match(i, j, size)


def numeric_similarity(value: Column, reference: Column) -> Column:
    """1 for numbers equal but for rounding, else 1 less the difference relative to the reference (or to 1), 0 at least."""
    gap = F.abs(value - reference)
    close = gap <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(value), F.abs(reference)), F.lit(1e-9))
    return F.when(value.isNull() | reference.isNull(), F.lit(None)).when(close, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - gap / F.greatest(F.abs(reference), F.lit(1.0))), 4))
