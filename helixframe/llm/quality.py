"""Line-first quality rules, with DataFrame functions only.

Each line with a word is judged by itself, by counts of its words; lines that fail are
removed; a document that loses too large a part of its word characters, or fails the document rules, is
rejected.  Everything is computed inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import WORD, WS, words_col

# Line rules; the patterns mean the same in Java and RE2, and none repeats a repetition of its
# own kind of characters, so that a line is judged in time that grows with its length.
#: Punctuation: a line of fewer than five words that doesn't end a sentence ...
ENDS = rf"[.!?:;\x22')\]…”’»]{WS}*\z"
#: ... or a line in which many words hold a symbol or a doubled mark.
MARK = r"[#*$%&|<>]|[!?][!?]"
#: Navigation: words set apart by bars, arrows or dots standing alone, or a known menu line.
BAR = r"^[|>»›·•]$"
MENU = rf"^{WS}*(home|menu|next|previous|back to top|log ?in|sign (in|up)|share|skip to|read more|contact us|about us|search){WORD}*({WS}+{WORD}+){{0,3}}{WS}*\z"
#: Boilerplate: legal and technical notices.
NOTICE = r"(all rights reserved|copyright (\(c\)|©|[0-9])|privacy policy|terms of (use|service)|cookie (policy|settings)|uses cookies|enable javascript|spdx-license-identifier|licensed under|lorem ipsum)"
#: Marks and bars fail a line from this many words on ...
LEAST_MARKS = 3
#: ... and marks, bars and notices only if they make up more than this part of the line's words: a bar
#: counts with the word that it sets apart, a notice as ten words.
DENSE_PERCENT, BAR_WORDS, NOTICE_WORDS = 30, 2, 10


def bad_line(line: Column) -> Column:
    """Lines that fail: short without the end of a sentence, dense with marks or bars, a menu, or mostly a notice."""
    low = F.lower(line)
    words = words_col(line)
    count = lambda pattern: F.size(F.filter(words, lambda w: F.rlike(w, F.lit(pattern))))
    dense = lambda n: 100 * n > DENSE_PERCENT * F.size(words)
    # the anchored pattern takes words whole (possessive), so it ends at the first that is missing
    five = F.rlike(line, F.lit(rf"^{WS}*+(?:{WORD}++{WS}++){{4}}{WORD}"))
    # cheap patterns first: a line without them isn't cut into words
    return (
        (~five & ~F.rlike(line, F.lit(ENDS)))
        | (F.rlike(line, F.lit(MARK)) & (count(MARK) >= LEAST_MARKS) & dense(count(MARK)))
        | (F.rlike(line, F.lit("[|>»›·•]")) & (count(BAR) >= LEAST_MARKS) & dense(BAR_WORDS * count(BAR)))
        | F.rlike(low, F.lit(MENU))
        | (F.rlike(low, F.lit(NOTICE)) & dense(NOTICE_WORDS * F.regexp_count(low, F.lit(NOTICE))))
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_col(text), ""))


def quality_rules(docs: DataFrame, min_words: int = 20, repeat_percent: int = 30, most_lost_percent: int = 50, window: int = 8) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_chars, clean_text, kept behind the columns of ``docs``.

    A null text has no words and no lines, so it fails (n_words < min_words); its
    clean_text is empty.  n_repeat_words counts the words that lie in a window of
    ``window`` words found twice or more in the text (windows are compared by 64-bit
    hashes).  A document is kept if it passes the document rules and its failing lines
    hold at most ``most_lost_percent`` % of its word characters.  Repeated rows and ids
    are judged row by row.  Columns of ``docs`` with the names above are replaced.

    Every line is judged once, by ``bad_line``.  Columns of ``docs`` whose names begin with
    ``_q_`` stop the job.
    """
    clash = [c for c in docs.columns if c.startswith("_q_")]
    if clash:
        raise ValueError(f"names that begin with _q_ are taken: {clash}")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_q_words", words_col(F.col("text")))
    out = out.withColumn("n_words", F.size("_q_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_q_words", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
    out = out.withColumn("_q_lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    out = out.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))

    # Windows: hashes of words, then of runs of them; positions are looked at only if some hash occurs twice.
    out = out.withColumn("_q_hash", F.transform("_q_words", lambda w: F.xxhash64(w)))
    wins = F.transform(F.sequence(F.lit(1), F.size("_q_hash") - (window - 1)), lambda i: F.xxhash64(F.slice("_q_hash", i, window)))
    out = out.withColumn("_q_win", F.when(F.size("_q_hash") >= window, wins).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("_q_win")) < F.size("_q_win")
    out = out.withColumn("_q_pair", F.when(twice, F.sort_array(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get("_q_pair", j)["h"] == e["h"], F.lit(False))
    at = F.transform("_q_pair", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
    out = out.withColumn("_q_at", F.when(F.col("_q_pair").isNotNull(), F.sort_array(F.filter(at, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        "_q_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + p + window - F.greatest(p, s["end"])).alias("n"), (p + window).alias("end")),
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))

    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), (F.rlike(x, F.lit(WORD)) & bad_line(x)).alias("bad")))
    out = out.withColumn("_q_judged", judged)
    out = out.withColumn("_q_lost", F.filter("_q_judged", lambda x: x["bad"]))
    out = out.withColumn("lost_chars", F.when(F.size("_q_lost") > 0, _word_chars(F.array_join("_q_lost.line", "\n"))).otherwise(0).cast("long"))
    clean = F.array_join(F.filter("_q_judged", lambda x: ~x["bad"])["line"], "\n")
    out = out.withColumn("clean_text", F.when(F.size("_q_lost") > 0, clean).otherwise(text))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost_percent * F.col("word_chars")))
    return out.drop("_q_words", "_q_lines", "_q_hash", "_q_win", "_q_pair", "_q_at", "_q_judged", "_q_lost")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that quality_rules keeps, with their failing lines removed and n_chars (if there) counted again.

    Other columns stay as they are, whatever their names.  Null and empty texts go; repeated
    rows are judged each; an empty table gives an empty one.

    The filter reads a column that isn't deterministic to the optimiser, so that it stays
    above the projections: pushed below them, each column of the rules would be put in
    for its name again and again, and the condition would grow without end.
    """
    whole = docs.select(F.struct(*docs.columns).alias("document"), "text")
    judged = quality_rules(whole).withColumn("_q_row", F.monotonically_increasing_id()).where("kept and _q_row >= 0")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[(new.get(c, F.col("document")[c])).alias(c) for c in docs.columns])


def ctes(docs: str, out: str) -> str:
    """SQL: CTEs that end with ``out``, the rows of ``docs``(doc_id, text, ...) with the counts, lost_chars, clean_text and the verdicts."""
    ends = ENDS.replace("'", "''")
    count = lambda pattern: f"len(list_filter(lw, lambda y: regexp_matches(y, '{pattern}')))"
    return rf"""{out}_w AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '') AS ws FROM {docs}),
{out}_win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM {out}_w)),
{out}_hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM {out}_win) WHERE n > 1),
{out}_rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM {out}_hit) GROUP BY rid),
{out}_line AS (SELECT rid, j, x, list_filter(regexp_split_to_array(x, '{WS}+'), lambda y: y <> '') AS lw FROM (SELECT rid, unnest(range(len(string_split(t, chr(10))))) AS j, unnest(string_split(t, chr(10))) AS x FROM {out}_w)),
{out}_seen AS (SELECT rid, j, x, len(lw) AS n, {count(MARK)} AS marks, {count(BAR)} AS bars, len(regexp_extract_all(lower(x), '{NOTICE}')) AS notices FROM {out}_line),
{out}_judged AS (SELECT *, n > 0 AND ((n < 5 AND NOT regexp_matches(x, '{ends}')) OR (marks >= {LEAST_MARKS} AND 100 * marks > {DENSE_PERCENT} * n) OR (bars >= {LEAST_MARKS} AND 100 * {BAR_WORDS} * bars > {DENSE_PERCENT} * n)
  OR regexp_matches(lower(x), '{MENU}') OR 100 * {NOTICE_WORDS} * notices > {DENSE_PERCENT} * n) AS bad FROM {out}_seen),
{out}_text AS (SELECT rid, CAST(coalesce(sum(length(regexp_replace(x, '{WS}+', '', 'g'))) FILTER (WHERE bad), 0) AS BIGINT) AS lost_chars, count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS n_dup_lines, coalesce(string_agg(x, chr(10) ORDER BY j) FILTER (WHERE NOT bad), '') AS clean_text FROM {out}_judged GROUP BY rid),
{out}_count AS (SELECT b.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{WS}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost_chars, clean_text
  FROM {out}_w b LEFT JOIN {out}_rep rep ON b.rid = rep.rid JOIN {out}_text l ON b.rid = l.rid),
{out}_base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM {out}_count),
{out} AS (SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM {out}_base)"""


#: DuckDB SQL for the query's rows.
ORACLE = f"WITH {ctes('documents', 'quality')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars FROM quality"
