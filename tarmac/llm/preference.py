"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Turns are gathered once into an array for each conversation, the only exchange of all texts; pairs are joined to the
arrays, and each pair is rendered from its two arrays inside the task. A pair is as large as its two conversations, which
are one row of the result; no other key gathers rows, so equal openings shared by many conversations put nothing together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.core import materialise, numbered

TEXTS = ("prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as (role, text), by turn, then role and text; null roles and texts are empty.

    Repeated rows stay repeated turns; turns without a number come first; rows without a conv_id are left out, since
    they belong to no conversation.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _last_answer(turns: Column) -> Column:
    """How many turns there are up to the last one of the assistant; 0 without one."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))


def _next_ids(ids: DataFrame) -> DataFrame:
    """(conv_id, next_id): for each of the distinct ids the next larger one, for the largest the smallest."""
    placed = materialise(numbered(ids, "conv_id"))
    n = placed.count()
    before = F.when(F.col("place") > 0, F.col("place")).otherwise(n) - 1
    return placed.join(placed.select(F.col("conv_id").alias("next_id"), before.alias("place")), "place").select("conv_id", "next_id")


def with_negatives(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen_turns, rejected_turns) for a table of single conversations: the rejected side
    of each is made from its neighbour.

    The rejected conversation has the turns before the last assistant turn, and in that turn's place the last assistant
    turn of the next conversation by id that has one; the last by id takes the first one's. The pair of conversation c is c, its
    chosen side too, and its rejected side has the id of that next conversation. Each conversation with an assistant turn has a pair. Where
    the neighbour's last answer is the same, as where a single conversation is its own neighbour, both sides are equal, the prefix
    is the whole of them, and both completions are empty: a pair that nothing can be learnt from.
    """
    whole = gathered(conversations).select("conv_id", "turns", _last_answer(F.col("turns")).alias("n")).where("n > 0")
    ids = conversations.where(F.col("conv_id").isNotNull() & (F.col("role") == "assistant")).select("conv_id").distinct()
    answers = whole.select(F.col("conv_id").alias("next_id"), F.element_at("turns", F.col("n"))["text"].alias("other"))
    swap = _next_ids(ids).join(answers, "next_id").select("conv_id", "next_id", "other")
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("n") - 1), F.array(F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    return whole.join(swap, "conv_id").select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("next_id").alias("rejected_id"), F.col("turns").alias("chosen_turns"), swapped.alias("rejected_turns"))


def render(chosen: list[tuple[str, str]], rejected: list[tuple[str, str]]) -> tuple[int, str, str, str, str, str]:
    """(n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask) of two lists of (role, text)."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda r, t: f"<|{r}|>\n{t}<|end|>\n"
    sides = []
    for turns in (chosen, rejected):
        at, shown, spans = 0, [], []
        for role, text in turns[n:]:
            shown.append(show(role, text))
            if role == "assistant":
                start = at + len(role) + 5
                spans.append(f"{start}:{start + len(text) + 7}")
            at += len(shown[-1])
        sides += ["".join(shown), ",".join(spans)]
    return n, "".join(show(*t) for t in chosen[:n]), *sides


def rendered(pairs: DataFrame) -> DataFrame:
    """All columns of pairs but chosen_turns and rejected_turns, and what format_preferences adds."""
    names = [c for c in pairs.columns if c not in ("chosen_turns", "rejected_turns")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            sides = [[[(t["role"], t["text"]) for t in x] for x in b.column(c).to_pylist()] for c in ("chosen_turns", "rejected_turns")]
            cols = list(zip(*map(render, *sides), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[*names, "n_prompt", *TEXTS])

    return pairs.mapInArrow(run, f"{kinds}, n_prompt long, {', '.join(f'{c} string' for c in TEXTS)}")


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each row of pairs (pair_id, chosen_id, rejected_id) whose conversations both have turns.

    pair_id, chosen_id, rejected_id; n_prompt, the turns of the longest common prefix (equal role and text); prompt, these
    rendered once; chosen and rejected, the rest of each; chosen_mask and rejected_mask, the spans start:end, joined by
    commas, of what is trained on: the text and the end mark of each assistant turn, in code points of the completion.
    A prefix that is a whole conversation leaves an empty completion with an empty mask. A turn is rendered as
    <|role|>, line feed, text, <|end|>, line feed. A pair_id that comes twice has two rows.
    """
    whole = gathered(conversations)
    for side in ("chosen", "rejected"):
        pairs = pairs.join(whole.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")), f"{side}_id")
    return rendered(pairs.select("pair_id", "chosen_id", "rejected_id", "chosen_turns", "rejected_turns"))


#: DuckDB text of rendered over with_negatives of the table conversations.
ORACLE = r"""
WITH plain AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, pos AS last_pos, text AS last_text FROM plain WHERE role = 'assistant'
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
circle AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM last),
swap AS (SELECT conv_id, next_id, a.last_pos, b.last_text AS other FROM last a JOIN circle USING (conv_id) JOIN last b ON b.conv_id = next_id),
turns AS (
  SELECT conv_id AS pair_id, 0 AS side, pos, role, text FROM plain
  UNION ALL SELECT conv_id, 1, pos, role, CASE WHEN pos = last_pos THEN other ELSE text END FROM plain JOIN swap USING (conv_id) WHERE pos <= last_pos),
pairs AS (SELECT conv_id AS pair_id, conv_id AS chosen_id, next_id AS rejected_id FROM swap),
lined AS (
  SELECT p.pair_id, c.pos AS cpos, c.role = r.role AND c.text = r.text AS same
  FROM pairs p JOIN turns c ON c.pair_id = p.pair_id AND c.side = 0 JOIN turns r ON r.pair_id = p.pair_id AND r.side = 1 AND r.pos = c.pos),
lengths AS (SELECT p.pair_id, least((SELECT count(*) FROM turns t WHERE t.pair_id = p.pair_id AND t.side = 0), (SELECT count(*) FROM turns t WHERE t.pair_id = p.pair_id AND t.side = 1)) AS n FROM pairs p),
prefix AS (
  SELECT l.pair_id, coalesce((SELECT min(cpos) FROM lined d WHERE d.pair_id = l.pair_id AND NOT d.same), l.n) AS n_prompt FROM lengths l),
shown AS (
  SELECT p.pair_id, t.side, t.pos, t.role, t.text, x.n_prompt,
         '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS shown, length(t.role) + 5 AS head
  FROM pairs p JOIN turns t USING (pair_id) JOIN prefix x USING (pair_id)),
spans AS (
  SELECT *, head + coalesce(sum(CASE WHEN pos >= n_prompt THEN length(shown) END)
    OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM shown),
done AS (
  SELECT pair_id, max(n_prompt) AS n_prompt,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos < n_prompt AND side = 0), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos >= n_prompt AND side = 0), '') AS chosen,
    coalesce(string_agg(start || ':' || (start + length(text) + 7), ',' ORDER BY pos) FILTER (pos >= n_prompt AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos >= n_prompt AND side = 1), '') AS rejected,
    coalesce(string_agg(start || ':' || (start + length(text) + 7), ',' ORDER BY pos) FILTER (pos >= n_prompt AND side = 1 AND role = 'assistant'), '') AS rejected_mask
  FROM spans GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, CAST(n_prompt AS BIGINT) AS n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask
FROM pairs JOIN done USING (pair_id)
"""
