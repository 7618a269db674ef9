"""Chat formatting (operator 2): a hidden Markov model over speaker markers and line features recovers the roles of a
transcript's lines by Viterbi; turns are then rendered in one canonical form."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant"]
#: Markers at the start of a line, by role, and what a line may be.
MARKERS = {
    "system": r"(?:system|instructions?|context)\s*:|<\|system\|>|<<sys>>|#+\s*(?:system|instruction)s?\b:?",
    "user": r"(?:user|human|question|q|customer|student)\s*:|<\|(?:user|prompter)\|>|\[inst\]|#+\s*(?:user|human|input|question)\b:?",
    "assistant": r"(?:assistant|ai|bot|answer|a|agent|gpt|model|response)\s*:|<\|assistant\|>|\[/inst\]|#+\s*(?:assistant|response|answer|output)\b:?",
}
_MARKERS = [re.compile(rf"\s*(?:{MARKERS[r]})\s*", re.IGNORECASE).match for r in ROLES]
#: Turns of one conversation that a task sees at once.
BLOCK = 256
SYMBOLS = (len(ROLES) + 1, 2, 4)


def line_features(line: str) -> tuple[int, int, int, int]:
    """Marker (0: none, else 1 + the role's number), question mark at the end, length class, and where the text begins."""
    found = next(((k + 1, m.end()) for k, match in enumerate(_MARKERS) if (m := match(line))), (0, 0))
    text = line[found[1] :].strip()
    n = len(text)
    return found[0], int(text.endswith("?")), (n > 0) + (n > 60) + (n > 240), found[1]


@dataclass
class Model:
    """Log-probabilities: of the first line's role, of the last one's, of steps (to the next row, within a row, within a
    row at a marker), and of each feature by role."""

    start: np.ndarray
    end: np.ndarray
    steps: np.ndarray
    features: list[np.ndarray]

    def emission(self, f: tuple[int, int, int]) -> np.ndarray:
        return sum(table[:, x] for table, x in zip(self.features, f, strict=True))


def _log(counts: np.ndarray, add: float = 1.0) -> np.ndarray:
    counts = np.asarray(counts, float) + add
    return np.log(counts / counts.sum(-1, keepdims=True))


def learn(labelled: DataFrame) -> Model:
    """A model from counts over all labelled rows (conv_id, turn, role, text); what reaches the driver are the counts.

    Rows of null or other roles are left out. Within a row a line keeps its speaker unless a marker says otherwise, and a
    marker names its role; these two are known beforehand and enter as counts of their own."""
    rows = labelled.filter(F.col("role").isin(ROLES) & F.col("turn").isNotNull() & F.col("conv_id").isNotNull())
    rows = rows.groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), F.struct("role", F.coalesce("text", F.lit("")))).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = rows.select("conv_id", "turn", "role").join(after, ["conv_id", "turn"], "full").groupBy("role", "next").count().collect()
    step, start, end = np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for r in pairs:  # 16 rows at most
        if r["role"] and r["next"]:
            step[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
        elif r["role"]:
            end[ROLES.index(r["role"])] += r["count"]
        else:
            start[ROLES.index(r["next"])] += r["count"]
    kind = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(F.trim(x).endswith("?").cast("int").alias("q"), ((F.length(F.trim(x)) > 0).cast("int") + (F.length(F.trim(x)) > 60).cast("int") + (F.length(F.trim(x)) > 240).cast("int")).alias("n")))
    counted = rows.select("role", F.explode(kind).alias("x")).groupBy("role", "x.q", "x.n").count().collect()
    question, length = np.zeros((3, 2)), np.zeros((3, 4))
    for r in counted:  # 24 rows at most
        question[ROLES.index(r["role"]), r["q"]] += r["count"]
        length[ROLES.index(r["role"]), r["n"]] += r["count"]
    marker = np.full((3, 4), 0.5)
    marker[:, 0] = 900
    marker[range(3), [1, 2, 3]] = 100
    stay, free = np.eye(3) * 997 + 1, np.full((3, 3), 1.0)
    return Model(_log(start), _log(end), np.stack([_log(step), _log(stay, 0), _log(free, 0)]), [_log(marker, 0), _log(question), _log(length)])


def _kind(first: bool, f: tuple[int, ...]) -> int:
    return 0 if first else 2 if f[0] else 1


def _lines(texts: list[str]) -> list[tuple[int, int, str, tuple[int, int, int, int]]]:
    """Of a block's texts: text's number, line's number, the line, its features."""
    return [(k, n, line, line_features(line)) for k, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]


def transfer(model: Model, lines: list) -> np.ndarray:
    """Best log-probability from a role before a block to a role at its end; blocks compose by (max, +) products."""
    total = None
    for _, n, _, f in lines:
        step = model.steps[_kind(n == 0, f)] + model.emission(f[:3])[None, :]
        total = step if total is None else (total[:, :, None] + step[None, :, :]).max(1)
    return total


def viterbi(model: Model, lines: list, before: np.ndarray, after: np.ndarray) -> list[int]:
    """The best roles of a block's lines, given scores of the roles before it (empty at the start of a conversation: then
    the first line has the model's start) and of those its last line may have. Ties go to the earlier role."""
    score, back = None, []
    for i, (_, n, _, f) in enumerate(lines):
        e = model.emission(f[:3])
        if i == 0 and not len(before):
            score = model.start + e
            back.append(np.zeros(3, int))
            continue
        to = (before if score is None else score)[:, None] + model.steps[_kind(n == 0, f)]
        back.append(to.argmax(0))
        score = to.max(0) + e
    at = int((score + after).argmax())
    out = [at]
    for b in back[:0:-1]:
        at = int(b[at])
        out.append(at)
    return out[::-1]


def format_chats(turns: DataFrame, model: Model) -> DataFrame:
    """One row per line: conv_id, turn, line (from 0), role (recovered), opens (a canonical turn begins), rendered.

    Joined in order of turn and line, ``rendered`` of a conversation is its canonical form: each turn is "<|role|>", a
    line break, its lines without markers, and "<|end|>". Any role column is not read. Long conversations are cut into
    blocks of ``BLOCK`` turn numbers: a first pass gives each block's best scores from role to role, a scan over these
    small tables the scores at the borders, and a second pass the roles, exactly as one Viterbi over all lines. Exactly
    repeated rows count once; rows that share a conversation and turn follow by their text. Turns of one role in a row
    become one canonical turn; ``turn`` still tells them apart. Null ids or turns are left
    out; null and empty texts are one empty line."""
    rows = turns.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    texts = lambda cell: [r["text"] for r in cell]
    kind = turns.schema["conv_id"].dataType.simpleString()

    def tables(parts):
        for p in parts:
            yield pd.DataFrame({"conv_id": p["conv_id"], "block": p["block"], "t": [transfer(model, _lines(texts(r))).ravel().tolist() for r in p["rows"]], "s": [_first(model, _lines(texts(r))) for r in p["rows"]]})

    def borders(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        t = [np.array(x).reshape(3, 3) for x in p["t"]]
        before, after = [np.empty(0)], [model.end]
        score = np.array(p["s"].iloc[0])
        for m in t[1:]:
            before.append(score)
            score = (score[:, None] + m).max(0)
        for m in t[:0:-1]:
            after.append((m + after[-1][None, :]).max(1))
        return pd.DataFrame({"conv_id": p["conv_id"], "block": p["block"], "before": [b.tolist() for b in before], "after": [a.tolist() for a in after[::-1]], "last": [*[False] * (len(t) - 1), True]})

    def roles(parts):
        for p in parts:
            out = []
            for conv, cell, before, after, last in zip(p["conv_id"], p["rows"], p["before"], p["after"], p["last"], strict=True):
                lines = _lines(texts(cell))
                before, after = np.array(before), np.array(after)
                path = viterbi(model, lines, before, after)
                # The role before is the one whose step into the block's first line is best; the one after likewise.
                first = int((before + model.steps[_kind(True, lines[0][3])][:, path[0]]).argmax()) if len(before) else -1
                for i, ((k, n, line, f), role) in enumerate(zip(lines, path, strict=True)):
                    opens = role != (path[i - 1] if i else first)
                    out.append((conv, int(cell[k]["turn"]), n, ROLES[role], opens, line[f[3] :].strip() if f[0] else line, not len(before) and i == 0, last and i == len(lines) - 1))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "line", "role", "opens", "text", "begins", "ends"])

    short = blocks.mapInPandas(tables, f"conv_id {kind}, block bigint, t array<double>, s array<double>")
    edge = short.groupBy("conv_id").applyInPandas(borders, f"conv_id {kind}, block bigint, before array<double>, after array<double>, last boolean")
    found = blocks.join(edge, ["conv_id", "block"]).mapInPandas(roles, f"conv_id {kind}, turn bigint, line int, role string, opens boolean, text string, begins boolean, ends boolean")
    head = F.when(F.col("opens"), F.concat(F.when(F.col("begins"), "").otherwise("<|end|>\n"), F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    tail = F.when(F.col("ends"), "<|end|>\n").otherwise("")
    return found.select("conv_id", "turn", "line", "role", "opens", F.concat(head, "text", F.lit("\n"), tail).alias("rendered"))


def _first(model: Model, lines: list) -> list[float]:
    """Scores of the last line's roles if the conversation begins with this block."""
    score = model.start + model.emission(lines[0][3][:3])
    for _, n, _, f in lines[1:]:
        score = (score[:, None] + model.steps[_kind(n == 0, f)]).max(0) + model.emission(f[:3])
    return score.tolist()
