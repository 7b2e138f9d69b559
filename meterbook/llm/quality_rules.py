"""Quality rules with adaptive thresholds, on DataFrame functions only.

Every text is measured in its own row (no shuffle of text): symbols, repeated
lines, words inside repeated three-word windows, capitals.  The shares, in
thousandths, go into mergeable quantile sketches per language and source: a
sketch is a count per log-linear bucket, so two sketches merge by adding
counts and a hot source costs no more than its few buckets.  A cutoff is the
upper quartile plus ``FENCE`` times the spread of its group, where groups of
fewer than ``min_docs`` documents take the merged sketch of their language, or
of everything.  Documents are then joined with the cutoffs of their group and
filtered.

Defined results: null text counts as empty and fails the base rules; null
language or source is a group of its own; repeated rows and null ids are kept
as they are; a table without rows gives no rows; columns besides id, text,
language and source are not read by the rules, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterbook.llm.common import let, words, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
FENCE = 3
#: The least spread of each share (thousandths): a group without any spread does not refuse small deviations.
LEAST_SPREAD = {"symbols": 15, "dup_lines": 130, "repeats": 100, "capitals": 40}
MIN_DOCS = 200
#: A table of cutoffs of at most so many groups (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _same(x: Column, y: Column) -> Column:
    return (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)


def repeat_words(found: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, the first included.

    Windows are sorted by hash, then words, so equal ones are neighbours.
    """

    def windows(w: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("p"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: F.coalesce(_same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(_same(x, F.get(s, i - 1)), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x.p))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc.n + p + 3 - F.greatest(p, acc.end)).alias("n"), (p + 3).alias("end"))

    def covered(w: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(F.aggregate(let(windows(w), repeated), start, add, lambda acc: acc.n))

    return let(found, covered).cast("long")


def _less(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            carry: bool = False) -> DataFrame:
    """Counts and shares of every document; with ``carry`` the whole input row goes along as ``row``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source")]
    if carry:
        own.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    def line_counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("all"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

    def word_counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), repeat_words(found).alias("repeated"))

    counted = docs.select(
        *own,
        let(words(text), word_counts).alias("w"),
        let(lines, line_counts).alias("l"),
        (F.length(F.translate(text, BLANKS, ""))).cast("long").alias("word_chars"),
        _less(text, SYMBOLS).cast("long").alias("n_symbols"),
        _less(text, CAPITALS).cast("long").alias("n_capitals"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")

    return counted.select(
        "id", "lang", "source", *(["row"] if carry else []),
        F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"),
        share("n_symbols", "word_chars").alias("symbols"), share("l.dup", "l.all").alias("dup_lines"),
        share("w.repeated", "w.n").alias("repeats"), share("n_capitals", "word_chars").alias("capitals"),
    )


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: exact below 64, then 32 to an octave."""
    return let(
        F.struct(value.alias("v"), F.length(F.bin(value)).alias("bits")),
        lambda x: F.when(x.v < 64, x.v).otherwise(64 + (x.bits - 7) * 32 + F.call_function("shiftright", x.v, x.bits - 6) - 32),
    ).cast("long")


def bucket_start(number: Column) -> Column:
    """The smallest value of a bucket."""
    octave = F.floor((number - 64) / 32).cast("int")
    return F.when(number < 64, number).otherwise(F.call_function("shiftleft", F.pmod(number - 64, F.lit(32)) + 32, octave + 1)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per group, share and bucket; partial counts are added before the shuffle."""
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("share"), bucket(F.col(m)).alias("bucket")) for m in LEAST_SPREAD]))
    return measured.select("lang", "source", parts.alias("x")).groupBy("lang", "source", "x.share", "x.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Lower and upper quartile and number of documents of each merged sketch."""
    merged = sketch.groupBy(*by, "share", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "share")  # as many rows as buckets, whatever the documents
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, bucket_start(F.col("bucket")))) for q in (1, 3)}
    return ranked.groupBy(*by, "share").agg(at[1].alias("q1"), at[3].alias("q3"), F.max("docs").alias("docs"))


def cutoffs(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, cut): the largest accepted value of each share, per group."""
    sketch = written(sketches(measured), "sketches")
    own = quartiles(sketch, ["lang", "source"]).toDF("lang", "source", "share", "q1", "q3", "docs")
    lang = quartiles(sketch, ["lang"]).toDF("g_lang", "g_share", "g_q1", "g_q3", "g_docs")
    every = quartiles(sketch, []).toDF("e_share", "e_q1", "e_q3", "e_docs")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("g_lang")) & (F.col("share") == F.col("g_share")))
    joined = joined.join(every, F.col("share") == F.col("e_share"))

    def pick(q: str) -> Column:
        return F.when(F.col("docs") >= min_docs, F.col(q)).when(F.col("g_docs") >= min_docs, F.col(f"g_{q}")).otherwise(F.col(f"e_{q}"))

    least = F.element_at(F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv]), F.col("share"))
    cut = pick("q3") + FENCE * F.greatest(pick("q3") - pick("q1"), least)
    return joined.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[F.max(F.when(F.col("share") == m, cut)).alias(f"cut_{m}") for m in LEAST_SPREAD]
    )


def judge(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``measured`` with base_failed and kept."""
    limits = written(cutoffs(measured, min_docs), "cutoffs")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for m in LEAST_SPREAD:
        within = within & (F.col(m) <= F.col(f"cut_{m}"))
    return measured.join(limits, same).withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts and verdict of every document."""
    measured = written(measure(docs, id_col, text_col, lang_col, source_col), "measured")
    return judge(measured, min_docs).select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
              min_docs: int = MIN_DOCS) -> DataFrame:
    """The kept rows, with the columns of ``docs``."""
    measured = written(measure(docs, id_col, text_col, lang_col, source_col, carry=True), "measured")
    kept = judge(measured, min_docs).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _sql_bucket(v: str) -> str:
    return f"CASE WHEN {v} < 64 THEN {v} ELSE 64 + (length(bin({v})) - 7) * 32 + ({v} >> (length(bin({v})) - 6)::BIGINT) - 32 END"


def _sql_quartiles(name: str, by: str) -> str:
    keys = f"{by}, share" if by else "share"
    return f"""
{name} AS (SELECT {keys}, min(CASE WHEN upto * 4 >= docs THEN start END) AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN start END) AS q3, max(docs) AS docs
  FROM (SELECT {keys}, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS docs,
      CASE WHEN bucket < 64 THEN bucket ELSE ((bucket - 64) % 32 + 32) << ((bucket - 64) // 32 + 1) END AS start
    FROM (SELECT {keys}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


def _sql() -> str:
    shares = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS share, {_sql_bucket(m)} AS bucket FROM shares" for m in LEAST_SPREAD)
    least = "CASE share " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in LEAST_SPREAD.items()) + " END"
    pick = {q: f"CASE WHEN o.docs >= {MIN_DOCS} THEN o.{q} WHEN g.docs >= {MIN_DOCS} THEN g.{q} ELSE e.{q} END" for q in ("q1", "q3")}
    within = " AND ".join(f"s.{m} <= (SELECT max(cut) FROM cuts c WHERE c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source "
                          f"AND c.share = '{m}')" for m in LEAST_SPREAD)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
lists AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM lists),
tri AS (SELECT r, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
hit AS (SELECT r, p, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS h FROM tri),
cov AS (SELECT r, h OR coalesce(lag(h) OVER o, false) OR coalesce(lag(h, 2) OVER o, false) AS c FROM hit WINDOW o AS (PARTITION BY r ORDER BY p)),
rep AS (SELECT r, count(*) AS n FROM cov WHERE c GROUP BY r),
counts AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(text) - length(translate(text, '{CAPITALS}', '')) AS n_capitals
  FROM lists LEFT JOIN rep USING (r)),
shares AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
    CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capitals FROM counts),
sketch AS (SELECT lang, source, share, bucket, count(*) AS n FROM ({shares}) GROUP BY ALL),
{_sql_quartiles("own", "lang, source")},
{_sql_quartiles("langs", "lang")},
{_sql_quartiles("every", "")},
cuts AS (SELECT o.lang, o.source, share, ({pick["q3"]}) + {FENCE} * greatest(({pick["q3"]}) - ({pick["q1"]}), {least}) AS cut
  FROM own o JOIN langs g USING (share) JOIN every e USING (share) WHERE g.lang IS NOT DISTINCT FROM o.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND {within} AS kept
FROM shares s"""


SQL = _sql()
