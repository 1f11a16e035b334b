"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Its
successive prefixes are rendered; what each adds is the turn's span, and a render
that does not begin with the one before rewrites history, which is reported and
has no spans. Inside a span the text is found by probes: two one-letter
texts agree exactly up to where a text begins.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import batch_rows
from hopweave.llm._units import over_units

Turn = tuple[str, str]

# Control strings of the template, fixed values.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<assistant>", "<system>", "<role>", "</role>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


class RewrittenHistory(ValueError):
    """The template changed what an earlier turn rendered to."""


def escape(text: str) -> str:
    """No control string is left; backslashes are doubled first, then each control string gets one after its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@functools.lru_cache(maxsize=1 << 16)  # emptied after each conversation
def _turn(role: str, text: str) -> str:
    t = escape(text)
    if role == "user":
        return f"<s>[INST] {t} [/INST]"
    if role == "assistant":
        return f"<assistant>{t}</s>"
    if role == "system":
        return f"<system>{t}</s>"
    return f"<role>{escape(role)}</role>{t}</s>"


def template(turns: list[Turn]) -> str:
    """The default template. user, assistant and system have marks of their own; any other role is spelled out."""
    return "".join([_turn(role, text) for role, text in turns])


def parse(rendered: str) -> list[Turn]:
    """Turns read back from the default template's output."""
    out, at = [], 0
    while at < len(rendered):
        for mark, close, role in (("<s>[INST] ", " [/INST]", "user"), ("<assistant>", "</s>", "assistant"), ("<system>", "</s>", "system"), ("<role>", "</s>", None)):
            if rendered.startswith(mark, at):
                at += len(mark)
                if role is None:
                    end = rendered.index("</role>", at)
                    role, at = unescape(rendered[at:end]), end + len("</role>")
                end = rendered.index(close, at)
                out.append((role, unescape(rendered[at:end])))
                at = end + len(close)
                break
        else:
            raise ValueError(f"no turn at {at}")
    return out


def _step(context: list[Turn], role: str, now: str, before: str, render, at: str) -> tuple[int, int]:
    """Where the text of the turn after context begins and ends in now."""
    probes = [render([*context, (role, x)]) for x in ("", "a", "b")]
    if not all(x.startswith(before) for x in (now, *probes)):
        raise RewrittenHistory(f"{at} changes what is before it")
    start = len(before) + len(os.path.commonprefix([x[len(before) :] for x in probes[1:]]))
    end = start + len(now) - len(probes[0])
    if not (len(before) <= start <= end <= len(now)) or now[:start] != probes[1][:start] or now[end:] != probes[0][start:]:
        raise RewrittenHistory(f"{at} has no single text span")
    return start, end


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The rendered conversation, and (span start, text start, text end, span end) of each turn.

    Every prefix is rendered, whatever the number of turns, so RewrittenHistory names the first turn whose prefix does not continue the one before. What a
    prefix costs is the template's affair; the default one keeps what its turns rendered to, so that a prefix is one joining of strings.
    """
    found, before = [], render([])
    for i, (role, _) in enumerate(turns):
        now = render(turns[: i + 1])
        start, end = _step(turns[:i], role, now, before, render, f"turn {i}")
        found.append((len(before), start, end, len(now)))
        before = now
    return before, found


def format_conversations(rows: DataFrame, render: Callable[[list[Turn]], str] = template) -> DataFrame:
    """(conv_id, formatted, spans, loss_spans, rewrites) of rows(conv_id, turn, role, text).

    Turns are ordered by turn, then role and text (nulls first); null role and text count as empty; rows with a null
    conv_id are one conversation; rows that repeat a turn are turns of their own; other columns are ignored. loss_spans are the text spans of assistant turns, in code points. rewrites is true,
    and there are no spans, where the template rewrites history. An empty table gives no rows.
    """

    def unit(t: pa.Table) -> pa.RecordBatch:
        turns = [(r or "", x or "") for r, x in zip(t["role"].to_pylist(), t["text"].to_pylist())]
        try:
            text, found, bad = *spans(turns, render), False
        except RewrittenHistory:
            text, found, bad = render(turns), [], True
        finally:
            _turn.cache_clear()
        pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        full = [{"start": s, "end": e} for s, _, _, e in found]
        loss = [{"start": s, "end": e} for (role, _), (_, s, e, _) in zip(turns, found) if role == "assistant"]
        return pa.RecordBatch.from_arrays([pa.array(t["conv_id"][:1].to_pylist(), pa.int64()), pa.array([text]), pa.array([full], pair), pa.array([loss], pair), pa.array([bad])], ["conv_id", "formatted", "spans", "loss_spans", "rewrites"])

    batch_rows(rows.sparkSession, 10_000)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("_k", F.coalesce("conv_id", F.lit(-(1 << 63)))).withColumn("_null", F.col("conv_id").isNull().cast("long"))
    return over_units(own, ["_k", "_null"], unit, "conv_id long, formatted string, spans array<struct<start:int,end:int>>, loss_spans array<struct<start:int,end:int>>, rewrites boolean", ["turn", "role", "text"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the op5 contract asks for, read back from format_conversations' output with the default template."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist()):
                turns = parse(text)
                said = [unescape(text[x["start"] : x["end"]]) for x in loss]
                got = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(text))
                for x, v in zip(out, got):
                    x.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *(pa.array(x, k) for x, k in zip(out, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -1 is added by the contract; rows that the table itself has under -1 are turns of the same conversation."""
    ok = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(more)))


def _sql() -> str:
    esc = "replace(t, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        esc = f"replace({esc}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, length({esc}) + CASE r WHEN 'user' THEN 18 WHEN 'assistant' THEN 15 WHEN 'system' THEN 12 ELSE length(r) + 17 END AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


OP5_SQL = _sql()
