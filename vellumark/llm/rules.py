"""Quality rules: a table of thresholds compiled into one projection of Spark expressions, with no user functions.

A measure is an expression over counts of one text (words, characters, lines, symbols, stop words, repeats), a rule bounds a measure. ``judge`` puts
the counts, the measures and the verdict of all rules into a projection without a shuffle, so the scan's partitions stay as they are and a hot source or group of copies
changes nothing. ``keep_clean`` filters by it.

Repeats: 64-bit hashes of single words are doubled to windows of two, four and eight; where two are equal, all are sorted, and neighbours of equal hash by their
words, so time is n log n of a text's own words.

A null text counts as an empty one; it has no words and fails. A text of any length is read whole, inside its row. Rows that share an id and repeated rows are judged one by one; there is
nothing to tie; an empty table gives no rows; extra columns are not read by ``judge``, and ``keep_clean`` returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, a power of two.
WINDOW = 8

#: Frequent words of the four languages; running text in any of them holds some.
STOP_WORDS = (
    "the of and to in is that for it was with as on by from at are this be or "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un une est que pour dans qui sur pas par au du avec "
    "el los que y a del se las por con para una su al lo como más pero"
).split()

#: Rule: measure, least, most (None: no bound). A text fails where a measure is outside.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("letters", "n_letters / word_chars", 0.7, None),
    ("capitals", "n_capitals / n_letters", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.01, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_line_chars", "dup_line_chars / line_chars", None, 0.2),
    ("bullets", "n_bullets / n_lines", None, 0.9),
    ("ellipses", "n_ellipses / n_lines", None, 0.3),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeats(words: Column) -> Column:
    """Words in windows found twice or more."""

    def covered(at: Column) -> Column:
        # Ascending starts of repeated windows: each adds what the next one does not.
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)

    def among(pairs: Column) -> Column:
        # Equal windows are neighbours after the sort.
        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(words, x["i"], WINDOW) == F.slice(words, y["i"], WINDOW))

        held = F.filter(pairs, lambda x, k: F.coalesce(same(x, F.get(pairs, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(pairs, k + 1)), F.lit(False)))
        return let(F.sort_array(F.transform(held, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, among))

    def doubled(hashes: Column, reach: int) -> Column:
        # Hashes of twice the words, from two that are ``reach`` words apart.
        return let(hashes, lambda hs: F.transform(hs, lambda h, k: F.xxhash64(h, F.get(hs, k + reach))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):
        hashes = doubled(hashes, reach)
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(F.slice(hashes, 1, F.size(words) - (WINDOW - 1)), windows))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.char_length(x))


def counts(text: Column) -> Column:
    """All counts of a text as one struct of longs."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(words: Column, lines: Column) -> Column:
        out = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.array_join(words, "")),
            "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeats(words),
            "n_lines": F.size(lines),
            "line_chars": _chars(lines),
            "dup_line_chars": _chars(lines) - _chars(F.array_distinct(lines)),
            "n_letters": F.char_length(F.regexp_replace(text, "\\P{L}+", "")),
            "n_capitals": F.char_length(F.regexp_replace(text, "\\P{Lu}+", "")),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_bullets": F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))),
            "n_ellipses": F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in out.items()])

    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def _fails(c: Column, measure: str, low: float | None, high: float | None) -> Column:
    above, below = (c[name] for name in measure.split(" / "))
    ratio = above.cast("double") / F.greatest(F.lit(1.0), below.cast("double"))
    return (F.lit(False) if low is None else ratio < low) | (F.lit(False) if high is None else ratio > high)


def judge(docs: DataFrame, rules: list = RULES, min_words: int = 20, max_repeats: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed`` (names of the rules that fail, comma-joined)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    c = F.col("c")
    df = docs.select(F.col(id_col).alias("doc_id"), counts(text).alias("c"))
    base = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > int(round(100 * max_repeats)) * c["n_words"])
    failed = F.array_compact(F.array(*[F.when(_fails(c, m, low, high), F.lit(name)) for name, m, low, high in rules]))
    kept = ~base & (F.size(failed) == 0)
    return df.select("doc_id", *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), kept.alias("kept"), F.concat_ws(",", failed).alias("failed"))


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows that all rules keep, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(text_col).alias("text"))
    return judge(rows, **options).where("kept").select("doc_id.*")


def _measure_sql(measure: str) -> str:
    above, below = measure.split(" / ")
    return f"{above}::double / greatest(1.0, {below}::double)"


def _rule_sql(name: str, measure: str, low: float | None, high: float | None) -> str:
    bounds = [f"{_measure_sql(measure)} {op} {bound}" for op, bound in (("<", low), (">", high)) if bound is not None]
    return f"case when {' or '.join(bounds)} then '{name}' end"


#: The same table of rules over counts that DuckDB takes by its own means: windows are rows, repeats a join of groups.
SQL = f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') as lines from t),
win as (select r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as x from (select r, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w)),
dup as (select r, i, lead(i) over (partition by r order by i) as next from (select r, i, count(*) over (partition by r, x) as n from win) where n > 1),
rep as (select r, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) as n from dup group by r),
c as (select doc_id, len(words) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
      coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
      coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as line_chars,
      coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0) as dup_line_chars,
      length(regexp_replace(text, '\\P{{L}}+', '', 'g')) as n_letters, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) as n_capitals,
      len(list_filter(words, lambda x: lower(x) in ({', '.join(f"'{x}'" for x in STOP_WORDS)}))) as n_stop_words,
      len(list_filter(lines, lambda x: substring(ltrim(x, ' '), 1, 1) in ('-', '*', '•'))) as n_bullets,
      len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') or suffix(rtrim(x, ' '), '…'))) as n_ellipses
      from w left join rep using (r)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, concat_ws(',', {', '.join(_rule_sql(*r) for r in RULES)}) as failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed = '' as kept, failed from j
"""
