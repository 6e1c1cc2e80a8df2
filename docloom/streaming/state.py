"""Structured Streaming: scrubbed token streams, evidence registries and activity sessions."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Where a credential may begin, and key blocks, which alone go over many lines.
LABEL = re.compile(r"(?i)\b(?:password|passcode|pin|api|access|refresh|secret|private|bearer|auth|token|ssh-|eyJ|[a-z][a-z0-9+.-]*:/)")
IDLE_SECONDS = 600  # after which a run without events is forgotten
KEY, KEY_END = re.compile(r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"(?i)-----END [A-Z ]*PRIVATE KEY-----")


def releasable(held: str, longest: int) -> int:
    """How many characters of ``held`` no later text can turn into part of a credential.

    A whole line goes unless it holds a label, whose value may stand on the next line, or is blank after such a line; a key
    block waits for its end. A line of more than ``longest`` characters without any label goes up to its last word.
    """
    until = at = 0
    while (key := KEY.search(held, at)) and (end := KEY_END.search(held, key.end())):
        at = end.end()
    until = key.start() if key else len(held)
    line = held.rfind("\n", 0, until) + 1
    if line == 0:
        return held.rfind(" ", 0, until) + 1 if until > longest and not LABEL.search(held, 0, until) else 0
    while line:
        start = held.rfind("\n", 0, line - 1) + 1
        if held[start:line].strip() and not LABEL.search(held, start, line):
            break
        line = start
    return max(line, at)


def scrub_stream(parts: DataFrame, redact, longest: int = 4000) -> DataFrame:
    """(stream_id, text): parts of text released line by line as they come, with credentials replaced.

    ``parts``: stream_id, seq, text, final. ``redact`` is a function on a text; what is released, put together, is what it
    makes of the whole, as rules work within lines, but for key blocks and labels before a line end, which are held back. The state holds an unfinished line
    or key block, and a line of more than ``longest`` characters only if it may hold a credential. Parts may come in
    any order; one is released once all before it are there.
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, nxt, held = ({}, 0, "") if not state.exists else (dict(zip(*state.get[:2], strict=True)), *state.get[2:4])
        ends = state.get[4] if state.exists else -1
        for pdf in batches:
            for seq, text, final in zip(pdf["seq"], pdf["text"], pdf["final"], strict=True):
                waiting[int(seq)] = text or ""
                ends = int(seq) if final else ends
        while nxt in waiting:
            held, nxt = held + waiting.pop(nxt), nxt + 1
        done = 0 <= ends < nxt
        cut = len(held) if done else releasable(held, longest)
        ready, held = redact(held[:cut]), held[cut:]
        if done:
            state.remove()
        else:
            state.update((list(waiting), list(waiting.values()), nxt, held, ends))
        yield pd.DataFrame({"stream_id": [key[0]] if ready else [], "text": [ready] if ready else []})

    kept = "seqs array<long>, texts array<string>, next long, held string, ends long"
    return parts.groupBy("stream_id").applyInPandasWithState(feed, "stream_id string, text string", kept, "append", GroupStateTimeout.NoTimeout)


def evidence_registry(items: DataFrame, most: int = 40) -> DataFrame:
    """(run_id, label, item_key): each run's different items numbered V1, V2, ... in order of arrival, ``most`` at the most.

    Runs are kept for good; ``registry.registry_stream`` forgets idle ones.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known, out = set(seen), []
        for pdf in batches:
            for item in pdf.sort_values("seq")["item_key"]:
                if item not in known and len(seen) < most:
                    known.add(item)
                    seen.append(item)
                    out.append((key[0], f"V{len(seen)}", item))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["run_id", "label", "item_key"])

    return items.groupBy("run_id").applyInPandasWithState(number, "run_id string, label string, item_key string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


LINE = re.compile(r"[^\n]*\n|[^\n]+")
NUMBER_OR_DATE = re.compile(r"\d[\d.,:/-]*")


def in_order(waiting: dict[int, tuple[str, bool]], nxt: int, batches: Iterator[pd.DataFrame]) -> tuple[str, bool, int]:
    """(text, done, next part): the parts that can be read on from part ``nxt``; others stay in ``waiting``."""
    for pdf in batches:
        for seq, text, final in zip(pdf["seq"], pdf["text"], pdf["final"], strict=True):
            if int(seq) >= nxt:
                waiting[int(seq)] = (text or "", bool(final))
    ready, done = [], False
    while nxt in waiting and not done:
        text, done = waiting.pop(nxt)
        ready.append(text)
        nxt += 1
    return "".join(ready), done, nxt


WAITING = "seqs array<long>, texts array<string>, finals array<boolean>, next long"


def unpacked(state: GroupState) -> tuple[dict[int, tuple[str, bool]], int, list]:
    """(waiting parts, next part, what else a state holds)."""
    if not state.exists:
        return {}, 0, []
    seqs, texts, finals, nxt, *rest = state.get
    return {k: (t, f) for k, t, f in zip(seqs, texts, finals, strict=True)}, nxt, rest


def packed(waiting: dict[int, tuple[str, bool]], nxt: int, *rest) -> tuple:
    return list(waiting), [t for t, _ in waiting.values()], [f for _, f in waiting.values()], nxt, *rest


def held_numbers(parts: DataFrame, grounded) -> DataFrame:
    """(stream_id, text): an answer released as it comes, but from the first number on only once the whole is there and checked.

    ``parts``: stream_id, seq from 0, text, final; they may come in any order, and one waits for all before it. ``grounded`` is
    a function on the whole answer: true if its numbers are. An answer that isn't grounded loses what was held; what was
    released holds no number.
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, nxt, rest = unpacked(state)
        sent, held = rest or ("", "")
        text, done, nxt = in_order(waiting, nxt, batches)
        held += text
        found = NUMBER_OR_DATE.search(held)
        cut = held.rfind(" ", 0, found.start() + 1) + 1 if found else held.rfind(" ") + 1
        ready, held = held[:cut], held[cut:]
        if done:
            ready += held if not NUMBER_OR_DATE.search(held) or grounded(sent + ready + held) else ""
            state.remove()
        else:
            state.update(packed(waiting, nxt, sent + ready, held))
        yield pd.DataFrame({"stream_id": [key[0]] if ready else [], "text": [ready] if ready else []})

    return parts.groupBy("stream_id").applyInPandasWithState(feed, "stream_id string, text string", f"{WAITING}, sent string, held string", "append", GroupStateTimeout.NoTimeout)


def projected_deltas(parts: DataFrame, project) -> DataFrame:
    """(stream_id, text): what a projection makes of an answer, line by line as lines end.

    ``parts`` as in ``held_numbers``. ``project`` is a function on a text that works within lines, such as one that drops
    citation marks; each line is projected once, with its line end, and the state holds the unfinished one alone.
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, nxt, rest = unpacked(state)
        text, done, nxt = in_order(waiting, nxt, batches)
        held = (rest[0] if rest else "") + text
        cut = len(held) if done else held.rfind("\n") + 1
        ready, held = "".join(map(project, LINE.findall(held[:cut]))), held[cut:]
        if done:
            state.remove()
        else:
            state.update(packed(waiting, nxt, held))
        yield pd.DataFrame({"stream_id": [key[0]] if ready else [], "text": [ready] if ready else []})

    return parts.groupBy("stream_id").applyInPandasWithState(feed, "stream_id string, text string", f"{WAITING}, held string", "append", GroupStateTimeout.NoTimeout)


def final_deltas(events: DataFrame, node: str, at: str | None = None, late: str = "10 minutes", ttl_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(run_id, seq, delta) of a run's state updates, given as whole texts so far: what each adds, from one node alone.

    ``events``: run_id, seq, node, text. An update that doesn't go on from the one before, or is shorter, adds nothing.
    With a column ``at`` of event times, a run that the watermark leaves behind by ``ttl_seconds`` has ended and is forgotten.
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [], "seq": [], "delta": []}).astype({"seq": "int64"})
            return
        (seen,) = state.get if state.exists else ("",)
        out, last = [], 0
        for pdf in batches:
            last = max(last, int(pdf[at].max().timestamp() * 1000)) if at else 0
            for seq, text in pdf.sort_values("seq")[["seq", "text"]].itertuples(index=False):
                if text and text != seen and text.startswith(seen):
                    out.append((key[0], int(seq), text[len(seen) :]))
                    seen = text
        state.update((seen,))
        if at:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * ttl_seconds)
        yield pd.DataFrame(out, columns=["run_id", "seq", "delta"]).astype({"seq": "int64"})

    mine = (events.withWatermark(at, late) if at else events).where(F.col("node") == node)
    return mine.groupBy("run_id").applyInPandasWithState(feed, "run_id string, seq long, delta string", "seen string", "append", GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout)


def live_topics(mentions: DataFrame, days: int = 30) -> DataFrame:
    """(user, topic, last_seen, expires_at) whenever a topic is mentioned; each mention keeps it for so many days.

    ``mentions``: user, topic, at. State is kept by (user, topic) until it expires by event time, then dropped.
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({"user": [], "topic": [], "last_seen": [], "expires_at": []})
        if state.hasTimedOut:
            state.remove()
            yield empty
            return
        (last,) = state.get if state.exists else (pd.Timestamp(0).to_pydatetime(),)
        last = max([last, *(x.to_pydatetime() for pdf in batches for x in pdf["at"])])
        state.update((last,))
        until = last + datetime.timedelta(days=days)
        state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user": [key[0]], "topic": [key[1]], "last_seen": [last], "expires_at": [until]})

    schema = "user string, topic string, last_seen timestamp, expires_at timestamp"
    rows = mentions.withWatermark("at", "1 day").groupBy("user", "topic")
    return rows.applyInPandasWithState(feed, schema, "last timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def activity(events: DataFrame, user: str, at: str, idle: str, late: str) -> DataFrame:
    """Sessions of a stream; events later than the watermark are left out, as late results of an old revision are."""
    gap = F.session_window(F.col(at), idle)
    return events.withWatermark(at, late).groupBy(user, gap.alias("session")).agg(F.count("*").alias("n_events"))
