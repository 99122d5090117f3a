"""Quality rules by distribution divergence, in DataFrame functions only.

One pass counts in every whole text its words, characters by class, common words,
repeated lines and words in repeated three-word windows. The counts of all documents of
a language, added up, are that language's reference. A document's two histograms are
compared with each reference by Jensen-Shannon distance, and the nearest language
decides. Documents under ``min_words`` words are not judged by distance, and the limit
of the word distance falls with the length of the document.

Defined results: a null text has no words; texts of under ``min_words`` words or with
more than half of their words in repeated windows fail on these grounds; without any
reference (no row has a language) nothing fails by distance; repeated rows are judged
alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: the most common words of the languages looked at
COMMON = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit",
    "de", "la", "le", "et", "les", "des", "un", "que",
    "en", "el", "y", "los", "del", "se", "las", "por",
)
CLASSES = ("lower", "space", "symbol", "upper", "digit", "mark", "beyond", "rest")
#: the characters that are taken out of a text for each class but the last, in turn
_STRIP = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+", r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\"()\-]+", r"[^\x00-\x7F]+")
_SPACE = r"[\x20\x09-\x0D]+"

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.30
#: the word histogram of n words may be max(least, base + fall / sqrt(n)) away: what sampling
#: alone moves it falls with the square root of the length
WORD_LEAST, WORD_BASE, WORD_FALL = 0.20, 0.08, 1.5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column, k: int = 3) -> Column:
    """How many words lie in windows of ``k`` words that occur more than once."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def count(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + j for j in range(k)])))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(in_order, positions))

    return _let(windows, count).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, ``classes`` and ``common`` of every text."""
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t0"))
    for k, strip in enumerate(_STRIP):
        rows = rows.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", strip, ""))
    n = [F.char_length(f"t{k}") for k in range(len(_STRIP) + 1)]
    classes = [(a - b).cast("long") for a, b in zip(n, n[1:])] + [n[-1].cast("long")]
    words = F.filter(F.split("t0", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("t0", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    low = F.filter(F.split(F.lower("t0"), _SPACE), lambda w: w.isin(*COMMON))

    def of(c: str):
        return lambda w: w == c

    common = _let(low, lambda a: F.array(*[F.size(F.filter(a, of(c))) for c in COMMON]))
    return rows.select(
        "doc_id",
        "lang",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*classes).alias("classes"),
        common.alias("common"),
    ).select(
        "doc_id", "lang", "w.n_words", (F.aggregate("classes", F.lit(0).cast("long"), lambda s, v: s + v) - F.get("classes", F.lit(1))).alias("word_chars"),
        F.get("classes", F.lit(2)).alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", "classes", "common",
    )


def _shares(counted: Column, total: Column) -> Column:
    return F.transform(counted, lambda c: c / total)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares (base 2, 0 to 1)."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)))


def _with_rest(common: Column, n_words: Column) -> Column:
    return F.concat(common.cast("array<long>"), F.array(n_words - F.aggregate(common, F.lit(0).cast("long"), lambda s, v: s + v)))


def judge(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    word_limit: tuple[float, float, float] = (WORD_LEAST, WORD_BASE, WORD_FALL),
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, class_distance and word_distance."""
    each = stored(counts(docs), "text-counts")
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(len(COMMON))]
    refs = each.where("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).where("n > 0").orderBy("lang").collect()  # a row a language
    n = F.col("n_words")
    distances = []
    for r in refs:
        chars = sum(r[f"c{k}"] for k in range(len(CLASSES)))
        ref_c = F.array(*[F.lit(r[f"c{k}"] / chars) for k in range(len(CLASSES))])
        ref_w = [r[f"w{k}"] for k in range(len(COMMON))]
        ref_w = F.array(*[F.lit(v / r["n"]) for v in [*ref_w, r["n"] - sum(ref_w)]])
        all_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, v: s + v)
        distances.append(
            F.struct(
                js_distance(_shares(F.col("classes"), all_chars), ref_c).alias("c"),
                js_distance(_shares(_with_rest(F.col("common"), n), n), ref_w).alias("w"),
            )
        )
    nearest = F.array_min(F.array(*[F.struct((d["c"] + d["w"]).alias("both"), d["c"].alias("c"), d["w"].alias("w")) for d in distances])) if refs else None
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n)
    rows = each.withColumn("base_failed", failed)
    near = F.when(n > 0, nearest) if refs else F.lit(None).cast("struct<both double, c double, w double>")
    rows = rows.withColumn("near", near)
    least, base, fall = word_limit
    most = F.greatest(F.lit(least), base + fall / F.sqrt(F.greatest(n, F.lit(1))))
    good = (F.coalesce(F.col("near.c"), F.lit(0.0)) <= max_class_distance) & (F.coalesce(F.col("near.w"), F.lit(0.0)) <= most)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept"),
        F.col("near.c").alias("class_distance"), F.col("near.w").alias("word_distance"),
    )


def oracle_sql() -> str:
    """DuckDB SQL of the base counts and the verdict, for unique doc_ids."""
    strips = "\n".join(f"s{k + 1} as materialized (select *, regexp_replace(t{k}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g') as t{k + 1} from s{k})," for k, p in enumerate(_STRIP))
    n = len(_STRIP)
    classes = ", ".join([f"length(t{k}) - length(t{k + 1})" for k in range(n)] + [f"length(t{n})"])
    common = ", ".join(f"len(list_filter(low, lambda x: x = '{c}'))" for c in COMMON)

    listed = ", ".join(f"'{c}'" for c in COMMON)

    def sums(column: str, k: int) -> str:
        return ", ".join(f"sum({column}[{i + 1}])" for i in range(k))

    def js(p: str, q: str, k: int) -> str:
        half = f"(({p}[i] + {q}[i]) / 2)"
        part = [f"case when {x}[i] > 0 then {x}[i] * log2({x}[i] / {half}) else 0.0 end" for x in (p, q)]
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {k + 1}), lambda i: ({part[0]} + {part[1]}) / 2))))"

    return f"""
with s0 as (select doc_id, lang, coalesce(text, '') as t0 from documents),
{strips}
w as materialized (select doc_id, lang, t0, regexp_extract_all(t0, '[^\\x20\\x09-\\x0D]+') as words, list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
        list_filter(regexp_extract_all(lower(t0), '[^\\x20\\x09-\\x0D]+'), lambda x: x in ({listed})) as low, [{classes}] as cls from s{n}),
c as materialized (select doc_id, lang, len(words)::bigint as n_words, (list_sum(cls) - cls[2])::bigint as word_chars, cls[3]::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, cls, [{common}] as com from w),
e as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select doc_id, i, word as a, lead(word) over o as b, lead(word, 2) over o as c from e window o as (partition by doc_id order by i)),
h as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g where c is not null),
r as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by doc_id),
f as (select lang, sum(n_words) as n, [{sums('cls', n + 1)}] as cls, [{sums('com', len(COMMON))}] as com from c where lang is not null group by lang having sum(n_words) > 0),
q as (select lang, list_transform(cls, lambda x: x / list_sum(cls)) as qc, list_transform(list_append(com, n - list_sum(com)), lambda x: x / n) as qw from f),
p as (select doc_id, list_transform(cls, lambda x: x / list_sum(cls)) as pc, list_transform(list_append(com, n_words - list_sum(com)), lambda x: x / n_words) as pw from c where n_words > 0),
j as (select doc_id, {js('pc', 'qc', n + 1)} as dc, {js('pw', 'qw', len(COMMON) + 1)} as dw from p, q),
m as (select doc_id, arg_min(dc, dc + dw) as dc, arg_min(dw, dc + dw) as dw from j group by doc_id),
b as (select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words, dc, dw from c left join r using (doc_id) left join m using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and coalesce(dc, 0) <= {MAX_CLASS_DISTANCE} and coalesce(dw, 0) <= greatest({WORD_LEAST}::double, {WORD_BASE}::double + {WORD_FALL}::double / sqrt(greatest(n_words, 1))) as kept
from b"""
