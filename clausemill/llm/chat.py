"""Chat formatting: the turns of a transcript and their roles by a hidden Markov model, and canonical rendering.

States are roles, each as the first line of a turn or as a later one. A line is observed through its speaker marker (``User:``, ``### Assistant``, ...) and
through features of its form; Viterbi finds the likeliest states over all lines of a conversation, and so both roles and where turns begin. Probabilities
are counted by Spark over turns with a known role; markers start from a weak prior that they name the speaker.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, released

ROLES = ("system", "user", "assistant")
STATES = [(r, True) for r in ROLES] + [(r, False) for r in ROLES]
#: Rows of a piece at most. Pieces are scored apart for each state before and after them, and the states at their edges are then chosen over the whole conversation.
PIECE = 256
NEVER = -1e9
#: Prior of a line's marker: a turn's first line has one that names the speaker in such a share, all other ones are odd. It counts as PRIOR_LINES lines and PRIOR_SHARE of those that are counted.
SELF, ODD = 0.3, 0.001
PRIOR_LINES, PRIOR_SHARE = 50.0, 0.05

# Speaker names as transcripts spell them.
SPEAKERS = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "prompt": "user", "q": "user", "you": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "chatbot": "assistant", "agent": "assistant", "answer": "assistant", "response": "assistant", "model": "assistant", "a": "assistant",
}
MARKER = re.compile(r"^\s*(?:<\|(\w{1,12})\|>|\[(\w{1,12})\]:?|#{1,4}\s*(\w{1,12})\s*:?\s*$|\**(\w{1,12})\**\s*(?:\(\w+\))?\s*[:>]\**)\s*", re.I)


def marker_of(line: str) -> tuple[str | None, str]:
    """(role that a speaker marker names, line without the marker)."""
    m = MARKER.match(line)
    role = SPEAKERS.get(next(g for g in m.groups() if g).lower()) if m else None
    return (role, line[m.end() :]) if role else (None, line)


def observations(line: str, row: str | None = None) -> list[str]:
    """The features that a line is observed through; `row` is the text that it begins if that is known to be a turn."""
    role, rest = marker_of(line)
    seen = [f"marker={role}", f"length={min(9, len(rest).bit_length())}", f"asks={rest.rstrip().endswith('?')}", f"form={form_of(rest)}"]
    return seen if row is None else [*seen, f"turn={min(14, 2 * len(row).bit_length() + (len(row) * 4 >> max(2, len(row).bit_length()) & 1) - 6)}"]


def form_of(line: str) -> str:
    text = line.lstrip()
    return "code" if text.startswith(("```", "    ", "$ ")) else "list" if re.match(r"[-*•]\s|\d+[.)]\s", text) else "blank" if not text else "upper" if text[0].isupper() else "other"


@dataclass
class ChatModel:
    """Log-probabilities, as plain dictionaries. Roles or features that weren't learnt get the smoothed rest."""

    start: dict[str, float]
    move: dict[tuple[str, str], float]
    stay: dict[str, float]  # that a line of the same turn follows
    emit: dict[tuple[str, bool, str], float]
    unseen: dict[tuple[str, bool, str], float]

    def line(self, role: str, first: bool, seen: list[str]) -> float:
        return sum(self.emit.get((role, first, f), self.unseen.get((role, first, f.partition("=")[0]), -6.0)) for f in seen)

    def scores(self, rows: list[str], rows_are_turns: bool) -> Iterator[list[float]]:
        """The score of each line of the rows under each of STATES."""
        for row in rows:
            for j, line in enumerate(row.split("\n")):
                seen = observations(line)
                if not rows_are_turns:
                    yield [self.line(r, first, seen) for r, first in STATES]
                elif j:
                    yield [NEVER if first else self.line(r, first, seen) for r, first in STATES]
                else:
                    seen = observations(line, row)
                    yield [self.line(r, first, seen) if first else NEVER for r, first in STATES]

    def ways(self) -> list[list[float]]:
        """ways[s][t]: log-probability of state t after state s."""
        out = []
        for q, _ in STATES:
            stay = self.stay.get(q, -0.7)
            leave = math.log(max(1e-9, 1 - math.exp(stay)))
            out.append([leave + self.move.get((q, r), -9.0) if first else stay if r == q else NEVER for r, first in STATES])
        return out

    def decode(self, rows: list[str], rows_are_turns: bool = False, before: int | None = None, last: int | None = None) -> list[int]:
        """States of the rows' lines, by Viterbi; at ties the state that stands first in STATES. `before` is the state of the line before, `last` that of the last line, where these are known."""
        ways, n, back = self.ways(), range(len(STATES)), []
        score: list[float] | None = None
        for own in self.scores(rows, rows_are_turns):
            if score is None:
                score = [own[t] + (self.opening(t) if before is None else ways[before][t]) for t in n]
                continue
            best = [max(n, key=lambda s, t=t: score[s] + ways[s][t]) for t in n]
            score = [score[s] + ways[s][t] + own[t] for t, s in zip(n, best, strict=True)]
            back.append(best)
        if score is None:
            return []
        out = [max(n, key=lambda t: score[t]) if last is None else last]
        for best in reversed(back):
            out.append(best[out[-1]])
        return out[::-1]

    def opening(self, state: int) -> float:
        role, first = STATES[state]
        return self.start.get(role, -9.0) if first else NEVER

    def transfer(self, rows: list[str], rows_are_turns: bool) -> list[float]:
        """Best scores of rows that end in each state: as a conversation's beginning, then after each state. (1 + states) x states."""
        ways, n, out = self.ways(), range(len(STATES)), None
        for own in self.scores(rows, rows_are_turns):
            if out is None:
                out = [[self.opening(t) + own[t] for t in n], *[[ways[s][t] + own[t] for t in n] for s in n]]
            else:
                out = [[max(x[s] + ways[s][t] for s in n) + own[t] for t in n] for x in out]
        return [x for row in out for x in row]


def edges(pieces: list[list[float]]) -> list[tuple[int | None, int]]:
    """(state before, last state) of each piece of a conversation on its likeliest path, from the pieces' transfer()."""
    n, score, back = len(STATES), pieces[0][: len(STATES)], []
    for p in pieces[1:]:
        ways = [[score[q] + p[n + n * q + r] for q in range(n)] for r in range(n)]
        back.append([w.index(max(w)) for w in ways])
        score = [max(w) for w in ways]
    at, out = score.index(max(score)), []
    for pointers in reversed(back):
        out.append((pointers[at], at))
        at = pointers[at]
    return [*out, (None, at)][::-1]


def learn(turns: DataFrame) -> ChatModel:
    """Counts features, role successions and lines of turns (conv_id, turn, role, text) whose conversation isn't held out; the counts' number is bounded by the features."""
    known = turns.filter(F.col("role").isin(*ROLES) & ~held_out(F.col("conv_id")) & F.col("text").isNotNull())
    least = known.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool, str], int] = defaultdict(int)
        for batch in batches:
            for role, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                for j, line in enumerate(text.split("\n")):
                    for f in [*observations(line, None if j else text), "line="]:
                        counts[role, j == 0, f] += 1
        keys = list(counts)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["role", "first", "feature", "n"])

    rows = known.select("role", "text").mapInArrow(count, "role string, first boolean, feature string, n long").groupBy("role", "first", "feature").agg(F.sum("n").alias("n")).collect()
    counts = {(r["role"], r["first"], r["feature"]): float(r["n"]) for r in rows}
    lines = {(r, first): counts.pop((r, first, "line="), 0.0) for r, first in STATES}
    prior = {}
    for r, first in STATES:
        share = {m: SELF if m == r and first else ODD for m in ROLES}
        share["None"] = 1 - sum(share.values())
        prior |= {(r, first, f"marker={m}"): x * (PRIOR_LINES + PRIOR_SHARE * lines[r, first]) for m, x in share.items()}
    kinds: dict[str, set[str]] = defaultdict(set)
    for _, _, f in [*counts, *prior]:
        kinds[f.partition("=")[0]].add(f)
    emit, unseen = {}, {}
    for r, first in STATES:
        for kind, features in kinds.items():
            weight = {f: counts.get((r, first, f), 0.0) + prior.get((r, first, f), 0.5) for f in features}
            total = sum(weight.values()) + 0.5
            emit |= {(r, first, f): math.log(w / total) for f, w in weight.items()}
            unseen[r, first, kind] = math.log(0.5 / total)
    pairs = known.select("conv_id", "turn", "role").alias("a").join(known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next")).alias("b"), ["conv_id", "turn"]).groupBy("role", "next").count().collect()
    firsts = known.join(least, "conv_id").filter("turn = first_turn").groupBy("role").count().collect()
    start = {r["role"]: math.log((r["count"] + 0.5) / (sum(x["count"] for x in firsts) + 1.5)) for r in firsts}
    move = {(r["role"], r["next"]): math.log((r["count"] + 0.5) / (sum(x["count"] for x in pairs if x["role"] == r["role"]) + 1.5)) for r in pairs}
    stay = {r: math.log((lines[r, False] + 0.5) / (lines[r, True] + lines[r, False] + 1.0)) for r in ROLES}
    return ChatModel(start, move, stay, emit, unseen)


def rendered(roles: list[str], texts: list[str]) -> str:
    """One block a turn: the role between bars, the text without its marker, an end mark."""
    return "\n".join(f"<|{r}|>\n{chr(10).join([marker_of(t)[1], *rest]).strip()}\n<|end|>" for r, (t, *rest) in zip(roles, ((x or "").split("\n") for x in texts), strict=True))


def turns_of(rows: list[str], states: list[int]) -> tuple[list[str], list[str]]:
    """(roles, texts) of the turns that lines and their states make; a conversation's lines before its first turn's are one too."""
    roles: list[str] = []
    texts: list[list[str]] = []
    for line, state in zip((x for row in rows for x in row.split("\n")), states, strict=True):
        role, first = STATES[state]
        if first or not texts:
            roles.append(role)
            texts.append([])
        texts[-1].append(line)
    return roles, ["\n".join(t) for t in texts]


def split_transcript(text: str, model: ChatModel) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript in one string."""
    return list(zip(*turns_of([text], model.decode([text])), strict=True))


def format_chats(turns: DataFrame, model: ChatModel, rows_are_turns: bool = True) -> DataFrame:
    """conv_id, piece, n_turns, roles (comma-joined), n_agree (rows whose first line begins a turn of the given role), chat for each piece of a conversation.

    Rows (conv_id, turn, role, text) are ordered by number, then by text. They are turns, or else parts of a transcript whose lines tell where turns begin; a turn
    that runs on into the next piece is rendered in both. Their given roles are only compared with. Null text: an empty row. Null turn: first.
    Null conv_id: each row is a conversation. States are those of the likeliest path of the whole conversation, of any length. Unknown given roles never agree. Repeated
    rows count each. Other columns are ignored. No rows: no rows.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    shared = scratch.share((model.start, model.move, model.stay, model.emit, model.unseen))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    keyed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), F.floor(F.coalesce("turn", F.lit(0)) / PIECE).cast("long").alias("part"), "turn", "role", "text")
    placed = keyed.repartition("conv_id", "alone", "part").sortWithinPartitions("conv_id", "alone", "part", "turn", "text", "role")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, held, piece = ChatModel(*shared.value), None, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal piece
            if held:
                texts = [t for _, t in held]
                # rows of the same hash without conv_id are conversations of their own
                out.append((*key, piece, f"{key[0]} {key[1]} {key[2]} {piece}", [g for g, _ in held], texts, own.transfer(texts, rows_are_turns)))
                held.clear()
                piece += 1

        for batch in batches:
            for conv, alone, part, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                if (conv, alone, part) != key or len(held) >= PIECE or key[1] is not None:
                    close()
                    if (conv, alone, part) != key:
                        key, piece = (conv, alone, part), 0
                held.append((role, text or ""))
            yield pieces_of(out)
            out.clear()
        close()
        yield pieces_of(out)
        released()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, held = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.extend((name, *edge) for name, edge in zip(names, edges(held), strict=True))
                names.clear()
                held.clear()

        def batch_out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["name", "before", "last"])
            out.clear()
            return made

        for batch in batches:
            for conv, alone, name, scores in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True):
                if (conv, alone) != key or alone is not None:
                    close()
                    key = (conv, alone)
                names.append(name)
                held.append(scores)
            yield batch_out()
        close()
        yield batch_out()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ChatModel(*shared.value)
        for batch in batches:
            out = []
            for conv, at, given, texts, before, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                states = own.decode(texts, rows_are_turns, before, last)
                roles, parts = turns_of(texts, states)
                begins, agree = 0, 0
                for g, t in zip(given, texts, strict=True):
                    agree += STATES[states[begins]] == (g, True)
                    begins += t.count("\n") + 1
                out.append((conv, at, len(roles), ",".join(roles), agree, rendered(roles, parts)))
            yield batch_of(out)
        released()

    pieces = scratch.put(placed.mapInArrow(cut, "conv_id long, alone long, part long, piece long, name string, given array<string>, texts array<string>, scores array<double>"), "pieces")
    chosen = pieces.select("conv_id", "alone", "part", "piece", "name", "scores").repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "part", "piece").mapInArrow(choose, "name string, before int, last int")
    whole = pieces.join(chosen, "name").select("conv_id", (F.col("part") + F.col("piece")).alias("piece"), "given", "texts", "before", "last")
    return whole.mapInArrow(render, "conv_id long, piece long, n_turns long, roles string, n_agree long, chat string")


# How transcripts of four styles mark system, user and assistant.
STYLES = [("System: ", "User: ", "Assistant: "), ("### Instruction\n", "### Human\n", "### Response\n"), ("[system] ", "[user] ", "[bot] "), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n")]


def transcripts(turns: DataFrame) -> DataFrame:
    """`turns` as parts of transcripts: each text after its speaker's marker, in a style by conversation; every fifth turn has none but a blank line."""
    style, marked = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES))), F.pmod(F.coalesce("turn", F.lit(0)), F.lit(5)) < 4
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            mark = F.when((style == k) & (F.col("role") == role), F.lit(name)).otherwise(mark)
    return turns.withColumn("text", F.when(marked, F.concat(mark, "text")).otherwise(F.concat(F.lit("\n"), "text")))


def pieces_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "alone", "part", "piece", "name", "given", "texts", "scores"])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "piece", "n_turns", "roles", "n_agree", "chat"])
