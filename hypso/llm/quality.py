"""Quality rules as robust multivariate outliers.

Each document has a vector of four transformed statistics: mean word length and the
square roots of its symbol, duplicate-line and repeated-window rates, all drawn towards
a prior so that short documents do not stand out by chance. For every language and
source the centre and scatter of the vectors are minimum-covariance-determinant
estimates: from a start at the medians and quartiles of the language, concentration steps take
the mean and covariance of the 75 % of documents with the smallest Mahalanobis distances,
each of which lowers the determinant until it stays; documents that would be rejected are in no
core. A document is rejected if its distance exceeds a chi-square quantile, or by the base rules
(under ten words, or a fifth of its words in repeated windows).

Small groups are no special case: to a group's sums over its core PRIOR documents are added that
are as its language's core on average, and to a language's as many like the core of all. So a
group of few documents is judged much like its language, a large one by itself; a language of few
documents is judged much like all.

All is DataFrame and SQL functions. The statistics are whole numbers, so sums don't
depend on their order, and a step is one pass that adds up moments by group and distance
bin; the core ends with a bin, so it has 75 % or a little more. The same SQL text states the
estimates for Spark and for other engines; tests hold them against numpy.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, exact, let, table, written

#: Unit of the transformed statistics: 1/256.
UNIT = 256
#: Least spread of each, in units: what a healthy group varies by even if it shows less.
FLOORS = (64.0, 12.0, 20.0, 20.0)
#: Share of a group that the estimates rest on, steps, distance bins for each fourth root.
CORE, STEPS, BINS = 0.75, 5, 64
#: Documents like its language's (the language's: like all) that are added to a group's, and to a
#: language's start: a few documents of a language unlike all others speak for themselves, one doesn't.
PRIOR, START = 40, 5
#: chi-square quantile (4 degrees of freedom) of 1 - 1e-6: the vectors have heavier tails than normal ones.
CUT = 33.38
WINDOW = 5


def _chi4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def consistency(core: float = CORE) -> float:
    """What the covariance of the core is multiplied by to be that of the whole, for normal vectors."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi4(mid) < core else (low, mid)
    six = 1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8)
    return core / six


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more, the first occurrence included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), p - F.get(starts, k - 1)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeats(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        starts = let(
            in_order,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda e, k: F.coalesce(e["x"] == F.get(s, k - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False))),
                    lambda e: e["i"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(starts, covered))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(windows, repeats))


def base_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """`_row` (the columns `keep` as a struct), language, source and the base statistics."""
    keep = docs.columns if keep is None else keep
    body = F.coalesce(exact(text), F.lit(""))
    words = let(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = let(
        F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")),
    )
    row = F.struct(*[exact(c) for c in keep]).alias("_row")
    named = lambda c, alias: F.coalesce(F.concat(F.lit("="), exact(c)), F.lit("")).alias(alias)
    found = docs.select(row, named(lang, "_lang"), named(source, "_source"), words.alias("_w"), lines.alias("_l"), F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"), F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return found.select(
        "_row", "_lang", "_source",
        F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("_l.d").cast("long").alias("n_dup_lines"), F.col("_w.r").cast("long").alias("n_repeat_words"), F.col("_l.n").cast("long").alias("n_lines"),
    )


#: Transformed statistics, for both engines.
TRANSFORMED = f"""SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  CAST(floor(CAST({UNIT} AS DOUBLE) * (word_chars + 100) / (n_words + 20)) AS BIGINT) AS x1,
  CAST(floor(CAST({UNIT} AS DOUBLE) * sqrt(CAST(n_symbols AS DOUBLE) / (word_chars + 50))) AS BIGINT) AS x2,
  CAST(floor(CAST({UNIT} AS DOUBLE) * sqrt(CAST(n_dup_lines AS DOUBLE) / (n_lines + 5))) AS BIGINT) AS x3,
  CAST(floor(CAST({UNIT} AS DOUBLE) * sqrt(CAST(n_repeat_words AS DOUBLE) / (n_words + 20))) AS BIGINT) AS x4"""

_GROUP = "concat('g', length(_lang), ':', _lang, '/', _source)"
_LANG = "concat('l', _lang)"
_LEVELS = ((0, "'*'", "'*'"), (1, _LANG, "'*'"), (2, _GROUP, _LANG))
#: Every group, language and all of them, with what each is drawn to and where it starts.
TREE = "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {g} AS g, {n} AS lev, {up} AS up, {_LANG if n else g} AS s FROM healthy" for n, g, up in _LEVELS) + ") every_level"
#: Healthy documents' vectors, once for each of the three.
FIT = " UNION ALL ".join(f"SELECT {g} AS g, x1, x2, x3, x4 FROM healthy" for _, g, _ in _LEVELS)


def _root(m: str, s: str) -> str:
    """Select items: the mean and the Cholesky factor of the covariance, from sums (`s` formats i, j) over n."""
    cov = lambda i, j: f"(({s.format(i=i, j=j)}) / n - ({m.format(i=i)}) * ({m.format(i=j)}))"
    items = [f"({m.format(i=i)}) AS m{i}" for i in range(1, 5)]
    for i in range(1, 5):
        for j in range(1, i + 1):
            items.append(f"{cov(j, i)}" + (f" + {FLOORS[i - 1] ** 2}" if i == j else "") + f" AS c{i}{j}")
    return ", ".join(items)


def _factor(source: str) -> str:
    """The Cholesky factor, column by column, each from the ones before."""
    f = [FLOORS[i] ** 2 / 4 for i in range(4)]
    one = f"SELECT *, sqrt(greatest(c11, {f[0]})) AS l11 FROM ({source}) a1"
    two = f"SELECT *, c21 / l11 AS l21, c31 / l11 AS l31, c41 / l11 AS l41 FROM ({one}) a2"
    three = f"SELECT *, sqrt(greatest(c22 - l21 * l21, {f[1]})) AS l22 FROM ({two}) a3"
    four = f"SELECT *, (c32 - l31 * l21) / l22 AS l32, (c42 - l41 * l21) / l22 AS l42 FROM ({three}) a4"
    five = f"SELECT *, sqrt(greatest(c33 - l31 * l31 - l32 * l32, {f[2]})) AS l33 FROM ({four}) a5"
    six = f"SELECT *, (c43 - l41 * l31 - l42 * l32) / l33 AS l43 FROM ({five}) a6"
    return f"SELECT g, n, m1, m2, m3, m4, l11, l21, l22, l31, l32, l33, l41, l42, l43, sqrt(greatest(c44 - l41 * l41 - l42 * l42 - l43 * l43, {f[3]})) AS l44 FROM ({six}) a7"


def _distance(source: str, more: str) -> str:
    """Squared Mahalanobis distances `d2` of the rows of source, which has vector and estimates; by forward substitution."""
    one = f"SELECT *, (x1 - m1) / l11 AS y1 FROM ({source}) b1"
    two = f"SELECT *, (x2 - m2 - l21 * y1) / l22 AS y2 FROM ({one}) b2"
    three = f"SELECT *, (x3 - m3 - l31 * y1 - l32 * y2) / l33 AS y3 FROM ({two}) b3"
    four = f"SELECT *, (x4 - m4 - l41 * y1 - l42 * y2 - l43 * y3) / l44 AS y4 FROM ({three}) b4"
    return f"SELECT {more}, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS d2 FROM ({four}) b5"


def _quartiles(fit: str, quantile: str) -> str:
    q = ", ".join(f"{quantile.format(x=f'x{i}', p=p)} AS q{i}{int(4 * p)}" for i in range(1, 5) for p in (0.25, 0.5, 0.75))
    return f"SELECT g, count(*) AS n, {q} FROM {fit} GROUP BY g"


_SUMS = [f"s{i}" for i in range(1, 5)] + [f"s{i}{j}" for i in range(1, 5) for j in range(i, 5)]


def _drawn(k: int) -> list[tuple[str, str]]:
    """From core sums c<k>: the sums with those that a group is drawn to, from all down to groups."""
    added = lambda own, up: ", ".join([f"coalesce({own}.n, 0) + {PRIOR} AS n", *(f"coalesce({own}.{x}, 0) + {PRIOR} * {up}.{x} / {up}.n AS {x}" for x in _SUMS)])
    names = ", ".join(["g", "n", *_SUMS])
    return [
        (f"a{k}", f"SELECT {names} FROM c{k} WHERE g = '*'"),
        (f"b{k}", f"SELECT tree.g AS g, {added(f'c{k}', f'a{k}')} FROM tree JOIN a{k} ON up = a{k}.g AND lev = 1 LEFT JOIN c{k} ON c{k}.g = tree.g"),
        (f"d{k}", f"SELECT tree.g AS g, {added(f'c{k}', f'b{k}')} FROM tree JOIN b{k} ON up = b{k}.g AND lev = 2 LEFT JOIN c{k} ON c{k}.g = tree.g"),
        (f"u{k}", f"SELECT {names} FROM a{k} UNION ALL SELECT {names} FROM b{k} UNION ALL SELECT {names} FROM d{k}"),
    ]


def estimates(quantile: str) -> list[list[tuple[str, str]]]:
    """Steps from `tree` and `fit` to p0 ... p<STEPS>, each a list of (name, select) of which the last is to be
    written: the robust centre and scatter of each group. quantile: the engine's exact, interpolated one."""
    spread = lambda i: f"((q{i}3 - q{i}1) / 1.349) * ((q{i}3 - q{i}1) / 1.349)"
    alone = ", ".join(["g", "CAST(n AS DOUBLE) AS n", *(f"CAST(q{i}2 AS DOUBLE) AS m{i}, {spread(i)} AS v{i}" for i in range(1, 5))])
    # A language's start is drawn to that of all, too, though much less.
    share = f"(o.n / (o.n + {START}))"
    mixed = ", ".join(["o.g AS g", "o.n AS n", *(f"{share} * o.m{i} + (1 - {share}) * r.m{i} AS m{i}, {share} * o.v{i} + (1 - {share}) * r.v{i} AS v{i}" for i in range(1, 5))])
    start = ", ".join(f"m{i}" for i in range(1, 5)) + ", " + ", ".join((f"v{i} + {FLOORS[i - 1] ** 2}" if i == j else "CAST(0 AS DOUBLE)") + f" AS c{i}{j}" for i in range(1, 5) for j in range(1, i + 1))
    quartiles = _quartiles("(SELECT fit.* FROM fit JOIN tree ON fit.g = tree.g AND tree.g = tree.s) started", quantile)
    begun = f"SELECT {alone} FROM q WHERE g = '*' UNION ALL SELECT {mixed} FROM (SELECT {alone} FROM q) o JOIN tree ON o.g = tree.g AND lev = 1 JOIN (SELECT {alone} FROM q) r ON up = r.g"
    out = [[("q", quartiles)], [("z", begun), ("p0", _factor(f"SELECT tree.g AS g, n, {start} FROM tree JOIN z ON tree.s = z.g"))]]
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in range(1, 5)] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(1, 5) for j in range(i, 5)])
    again = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {x}" for x in _SUMS)
    for k in range(1, STEPS + 1):
        joined = f"SELECT fit.g AS g, x1, x2, x3, x4, m1, m2, m3, m4, l11, l21, l22, l31, l32, l33, l41, l42, l43, l44 FROM fit JOIN p{k - 1} ON fit.g = p{k - 1}.g"
        binned = f"SELECT *, CAST(floor({BINS} * sqrt(sqrt(d2))) AS BIGINT) AS bin FROM ({_distance(joined, 'g, x1, x2, x3, x4')}) d"
        moments = f"SELECT g, bin, count(*) AS k, {sums} FROM ({binned}) e GROUP BY g, bin"
        upto = f"SELECT *, sum(k) OVER (PARTITION BY g ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k AS before, sum(k) OVER (PARTITION BY g) AS total FROM t{k}"
        core = f"SELECT g, CAST(sum(k) AS DOUBLE) AS n, {again} FROM h{k} WHERE before < {CORE} * total AND bin <= {int(BINS * (CUT * consistency()) ** 0.25)} GROUP BY g"
        estimate = _factor("SELECT g, n, " + _root("s{i} / n", "s{i}{j}") + f" FROM u{k}")
        # The sums are a row a group; what follows from them needs no shuffle.
        out += [[(f"t{k}", moments), (f"h{k}", upto), (f"c{k}", core)], [*_drawn(k), (f"p{k}", estimate)]]
    return out


def verdicts(rest: str) -> str:
    """The final select over `all_rows`: joins groups and estimates; rest: columns to return."""
    last = f"p{STEPS}"
    joined = f"SELECT a.*, m1, m2, m3, m4, l11, l21, l22, l31, l32, l33, l41, l42, l43, l44 FROM (SELECT *, {_GROUP} AS own FROM all_rows) a LEFT JOIN {last} ON own = {last}.g"
    apart = _distance(joined, "*")
    return f"""SELECT {rest}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(d2 <= {CUT * consistency()}, true)) AS kept
FROM ({apart}) verdict"""


def judged(docs: DataFrame, keep: list[str] | None = None, **columns) -> DataFrame:
    """`_row` with the base statistics, base_failed and kept.

    A null or empty text has no words and fails the base rules. Null languages and sources are
    groups of their own. Groups of any size, of one document too, are judged by an estimate that
    is drawn to their language's. Very long texts count whole. Repeated rows each count and get the
    same verdict; documents at the same distance share theirs. An empty table gives an empty result.
    Extra columns stay in `_row`.
    """
    spark = docs.sparkSession
    base = base_statistics(docs, keep=keep, **columns)
    rows = written(spark.sql(TRANSFORMED + " FROM {rows}", rows=base))
    healthy = "WITH healthy AS (SELECT _lang, _source, x1, x2, x3, x4 FROM {rows} WHERE NOT base_failed)\n"
    frames = {"tree": written(spark.sql(healthy + TREE, rows=rows)), "fit": spark.sql(healthy + FIT, rows=rows)}
    for step in estimates("percentile({x}, {p})"):  # the estimates are a row a group; lineage is cut after each step
        *before, (name, last) = step
        named = [f"{n} AS ({x})" for n, x in before]
        used = " ".join([*named, last])
        known = [n for n in frames if re.search(rf"\b{n}\b(?!\.)", used)]
        text = "WITH " + ",\n".join([*(f"{n} AS (SELECT * FROM {{{n}}})" for n in known), *named]) + f"\n{last}"
        frames[name] = written(spark.sql(text, **{n: frames[n] for n in known}))
    last = f"p{STEPS}"
    return spark.sql(f"WITH all_rows AS (SELECT * FROM {{rows}}), {last} AS (SELECT * FROM {{{last}}})\n" + verdicts("_row"), rows=rows, **{last: frames[last]})


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with; null and empty texts go, as they have
    no words. Ties, repeated rows, long texts, empty tables and extra columns: as in judged()."""
    return judged(docs).where("kept").select("_row.*")


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; see judged()."""
    out = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    word = WORD
    steps = ",\n".join(f"{name} AS ({select})" for step in estimates("quantile_cont({x}, {p})") for name, select in step)
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce('=' || lang, '') AS _lang, coalesce('=' || source, '') AS _source FROM documents),
word_lists AS (SELECT rid, regexp_extract_all(t, '{word}') AS w FROM texts),
windows AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM word_lists)),
twice AS (SELECT rid, x FROM windows GROUP BY rid, x HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS r FROM windows JOIN twice USING (rid, x), (SELECT unnest(range(0, {WINDOW})) AS o) GROUP BY rid),
line_lists AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS l FROM texts),
stats AS (
  SELECT doc_id, _lang, _source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM texts JOIN word_lists USING (rid) JOIN line_lists USING (rid) LEFT JOIN covered USING (rid)),
all_rows AS ({TRANSFORMED} FROM stats),
healthy AS (SELECT * FROM all_rows WHERE NOT base_failed),
tree AS ({TREE}),
fit AS ({FIT}),
{steps}
{verdicts("doc_id")}"""
