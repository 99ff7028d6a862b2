"""Secrets in whole texts: fixed patterns, and a character convolutional network in numpy.

Every candidate (a pattern's match, or a long run of key characters with a digit) is read
with its surroundings as characters marked inside or outside.  Filters of five characters
slide over them, the largest response of each goes into a logistic unit.  The network
learns from labelled findings: candidates that a pattern confirms, against the others.
Half of the time the surroundings are blanked, so that a value's own shape must do, and
confirmed values are shown in other notations and in the surroundings of other candidates
as well.  A part of the findings that the network did not see calibrates its score; those
of its confirmed values that would be candidates without a pattern, shown without their
keyword, set the threshold: the highest that finds the wanted share of them.  The others
have no say in it, for a secret that no pattern knows is one of them.  For the same reason
networks of one half of the findings judge the other half first, and the other candidates
that reach their threshold are not learned from.  Spans of patterns always stay; the
network adds candidates that reach the threshold.

All findings of a table are learned from, and all that are held back calibrate the score
and set the threshold.  They are dealt to parts by a hash; a task trains on one part, the
networks of all parts are averaged, and the next round begins with the average.
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, written
from weftline.llm.subwords import logistic_fit

# The patterns of findings and how long a finding is at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "learned")
#: Other candidates: runs of 16 or more key characters with a digit.
WIDE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
BASE62 = string.digits + string.ascii_letters

CONTEXT = 16
FILTERS, REACH, EPOCHS = 24, 5, 12
SYMBOLS = 2 * 129  # ASCII and one for the rest, outside and inside
#: Findings of a part, about, and rounds of training where there is more than one part.
PART, ROUNDS = 1000, 4
#: Symbols that a batch is closed at, and characters up to which a value is shown in other notations.
BATCH_SYMBOLS, SHOWN_LONGEST = 1 << 17, 4096
#: Raw scores of held findings are counted in steps of one in so many, up to a limit.
STEPS, FARTHEST = 256, 256
RECALL = 0.98

CANDIDATE = "struct<kind:string,start:int,end:int,left:string,value:string,right:string>"


def base_findings(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the value starts) of the patterns' findings, by start and kind."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(kind, m.start(), m.end(), m.start()) for kind, pattern in (("access", ACCESS), ("hex", HEX)) for m in pattern.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def candidates(text: str) -> list[dict]:
    """All candidates of a whole text; those of no pattern have the kind ``wide``."""
    found = base_findings(text)
    taken = sorted((a, b) for _, a, b, _ in found)
    at = 0
    for m in WIDE.finditer(text):
        if DIGIT.search(m[0]):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            k = at
            while k < len(taken) and taken[k][0] < m.end() and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or taken[k][0] >= m.end():
                found.append(("wide", m.start(), m.end(), m.start()))
    return [
        {"kind": kind, "start": a, "end": b, "left": text[max(0, v - CONTEXT) : v], "value": text[v:b], "right": text[b : b + CONTEXT]}
        for kind, a, b, v in found
    ]


def symbols(left: str, value: str, right: str) -> np.ndarray:
    """A candidate as symbols, with as many blanks around as a filter reaches."""
    out = []
    for text, inside in ((" " * REACH + left, 0), (value, 129), (right + " " * REACH, 0)):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out.append(np.minimum(codes, 128).astype(np.int64) + inside)
    return np.concatenate(out)


@dataclass
class Network:
    filters: np.ndarray  # REACH x SYMBOLS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # bias last
    seen: list[np.ndarray]  # squared gradients of the three so far
    scale: np.ndarray = None  # calibration: slope, shift
    threshold: float = 1.1

    def responses(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter to each row, and where in all rows it starts."""
        flat = np.concatenate(rows)
        n = len(flat) - REACH + 1
        z = self.bias + sum(self.filters[k][flat[k : k + n]] for k in range(REACH))
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        best, place = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            part = z[a : b - REACH + 1]
            place[i] = part.argmax(axis=0) + a
            best[i] = z[place[i], np.arange(FILTERS)]
        return np.maximum(best, 0), place

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for picked in batches_of(np.arange(len(rows)), rows, 128):
            best, _ = self.responses([rows[i] for i in picked])
            out[picked] = best @ self.out[:-1] + self.out[-1]
        return out

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) * self.scale[0] + self.scale[1], -30, 30)))

    def learn(self, rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, rate: float = 0.05) -> None:
        flat_of = lambda picked: np.concatenate([rows[i] for i in picked])
        for _ in range(epochs):
            for picked in batches_of(rng.permutation(len(rows)), rows, 64):
                best, place = self.responses([rows[i] for i in picked])
                p = 1 / (1 + np.exp(-np.clip(best @ self.out[:-1] + self.out[-1], -30, 30)))
                error = (p - y[picked]) / len(picked)
                back = np.where(best > 0, error[:, None] * self.out[:-1], 0).astype(np.float32)
                step = np.zeros_like(self.filters)
                flat, columns = flat_of(picked), np.broadcast_to(np.arange(FILTERS), place.shape)
                for k in range(REACH):
                    np.add.at(step[k], (flat[place + k], columns), back)
                steps = (step, back.sum(axis=0), np.append(best.T @ error, error.sum()).astype(np.float32))
                for value, change, total in zip((self.filters, self.bias, self.out), steps, self.seen):
                    total += change**2
                    value -= rate * change / np.sqrt(total)

    def state(self) -> np.ndarray:
        """What training changes, as one row of numbers."""
        return np.concatenate([x.ravel() for x in (self.filters, self.bias, self.out, *self.seen)])


def network(state: np.ndarray | None = None) -> Network:
    """A network before training, or one in this state."""
    shapes = ((REACH, SYMBOLS, FILTERS), (FILTERS,), (FILTERS + 1,))
    if state is None:
        rng = np.random.default_rng(5)
        own = [rng.normal(0, 0.1, shapes[0]).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS + 1).astype(np.float32)]
        return Network(*own, [np.full(x, 1e-4, np.float32) for x in shapes])
    cuts = np.cumsum([int(np.prod(x)) for x in shapes * 2])[:-1]
    values = [x.reshape(shape).astype(np.float32) for x, shape in zip(np.split(state, cuts), shapes * 2)]
    return Network(*values[:3], values[3:])


def batches_of(order: np.ndarray, rows: list[np.ndarray], most: int):
    """``order`` in batches of at most ``most`` rows; rows with many symbols make smaller ones."""
    begin, size = 0, 0
    for at, i in enumerate(order):
        if at > begin and (at - begin == most or size + len(rows[i]) > BATCH_SYMBOLS):
            yield order[begin:at]
            begin, size = at, 0
        size += len(rows[i])
    if len(order):
        yield order[begin:]


def other_notations(value: str, rng: np.random.Generator) -> list[str]:
    """A key of hexadecimal digits in capitals, base64 and its kin and base 62, whole and at other lengths."""
    if len(value) > SHOWN_LONGEST or not re.fullmatch("(?:[0-9a-f]{2})+", value):
        return []
    key, out = bytes.fromhex(value), [value.upper()]
    for size in (len(key), *rng.integers(12, 49, 2)):
        part = (key + rng.bytes(48))[:size] if size != len(key) else key
        number, digits = int.from_bytes(part, "big"), []
        while number:
            number, digit = divmod(number, len(BASE62))
            digits.append(BASE62[digit])
        whole = base64.b64encode(part).decode()
        out += [whole, whole.rstrip("="), base64.urlsafe_b64encode(part).decode().rstrip("="), "".join(digits) or "0"]
    return list(dict.fromkeys(out))


def without_keyword(confirmed: list[tuple], others: list[tuple], rng: np.random.Generator) -> list[tuple]:
    """Confirmed values in each notation: between blanks, or an other candidate's surroundings.

    Some of the latter begin like that candidate, so that the sign of a vendor, which many
    of the others may share, does not speak against a key behind it.
    """
    out = []
    for label, left, value, right in confirmed:
        for i, shown in enumerate((value, *other_notations(value, rng))):
            if i % 2 == 0 or not others:
                out.append((label, " " * len(left), shown, " " * len(right)))
            if i % 2 or i == 0 and others:
                _, before, start, behind = others[rng.integers(len(others))]
                out.append((label, before, start[: rng.integers(0, 7)] + shown, behind))
    return out


def unlike_confirmed(findings: list[tuple], net: Network | None) -> list[tuple]:
    """``findings`` (label, left, value, right) without the other candidates that a network takes for secrets."""
    if net is None or not findings:
        return findings
    score = net.probability([symbols(*p[1:]) for p in findings])
    return [p for p, s in zip(findings, score) if p[0] or s < net.threshold]


#: Findings are dealt to eight folds by a hash: two are held, three each make a half.
HELD, HALVES = frozenset({3, 7}), (frozenset({0, 1, 2}), frozenset({4, 5, 6}))
ALL = frozenset(range(8))


@dataclass
class Part:
    """The findings of a part that are in some folds, as far as judges leave them, and its other candidates."""

    rows: list[tuple]
    around: list[tuple]


def part_of(findings: pd.DataFrame, folds: frozenset, judges: list[tuple[frozenset, Network | None]]) -> Part:
    """``judges`` are (folds, network): a network that has not seen those folds."""
    findings = findings.sort_values(["at", "label", "value", "left", "right"])
    fold = (findings["at"].to_numpy() % 8).tolist()
    each = list(zip(findings["label"], findings["left"], findings["value"], findings["right"]))
    own = [(f, e) for f, e in zip(fold, each) if f in folds]
    rows = []
    for some, net in judges or [(ALL, None)]:
        rows += unlike_confirmed([e for f, e in own if f in some], net)
    return Part(rows, [e for e in each if not e[0]])


def shown_for_learning(part: Part, rng: np.random.Generator) -> list[tuple]:
    """Findings as they are, confirmed values without their keyword, others without surroundings."""
    confirmed = [p for p in part.rows if p[0]]
    blank = [(label, " " * len(left), value, " " * len(right)) for label, left, value, right in part.rows if not label]
    return [*part.rows, *without_keyword(confirmed, part.around, rng), *blank]


def per_part(findings: DataFrame, parts: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` over each part, in a task of its own where hashes allow."""
    return findings.repartition(parts, "part").groupBy("part").applyInPandas(work, schema)


def trained(findings: DataFrame, parts: int, folds: frozenset, judges: list) -> Network | None:
    """A network from all findings in ``folds`` that the judges leave; None where a label has none."""
    shared = findings.sparkSession.sparkContext.broadcast

    def begin(net: Network, epochs: int, judges: list):
        sent = shared((net.state(), judges))

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            state, judges = sent.value
            net, rng, part = network(state), np.random.default_rng([5, int(pdf["part"].iloc[0])]), part_of(pdf, folds, judges)
            shown = shown_for_learning(part, rng)
            if not shown:
                return pd.DataFrame({"part": [], "weight": [], "labels": [], "state": []})
            net.learn([symbols(*s[1:]) for s in shown], np.array([s[0] for s in shown], np.float32), rng, epochs)
            labels = sum(1 << label for label in {p[0] for p in part.rows})
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "weight": [float(len(shown))], "labels": [labels], "state": [net.state().tobytes()]})

        return work

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        mixed = sum(w * np.frombuffer(s, np.float32).astype(float) for w, s in zip(pdf["weight"], pdf["state"]))
        return pd.DataFrame({"few": [pdf["few"].iloc[0]], "weight": [pdf["weight"].sum()], "labels": [np.bitwise_or.reduce(pdf["labels"])], "state": [mixed.tobytes()]})

    net = network()
    for epochs in [EPOCHS] if parts == 1 else [EPOCHS // ROUNDS] * ROUNDS:
        each = per_part(findings, parts, begin(net, epochs, judges), "part long, weight double, labels int, state binary")
        few = each.withColumn("few", F.pmod("part", F.lit(16))).groupBy("few").applyInPandas(total, "few long, weight double, labels int, state binary")
        sums = sorted(few.collect())
        if not sums or np.bitwise_or.reduce([r["labels"] for r in sums]) != 3:
            return None
        net = network(sum(np.frombuffer(r["state"], float) for r in sums) / sum(r["weight"] for r in sums))
    return net


def calibrated(net: Network | None, findings: DataFrame, parts: int, folds: frozenset, judges: list) -> Network | None:
    """``net`` with scale and threshold from all findings in ``folds``; their raw scores are counted in small steps."""
    if net is None:
        return None
    sent = findings.sparkSession.sparkContext.broadcast((net, judges))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        net, judges = sent.value
        part, rng = part_of(pdf, folds, judges), np.random.default_rng([6, int(pdf["part"].iloc[0])])
        bare = without_keyword([p for p in part.rows if p[0]], part.around, rng)
        # Only what would be a candidate without a pattern tells how sure the network has to be.
        deciding = [bool(WIDE.fullmatch(b[2]) and DIGIT.search(b[2])) for b in bare]
        rows = [*part.rows, *bare]
        raw = net.raw([symbols(*h[1:]) for h in rows]) if rows else np.zeros(0)
        step = np.floor(np.clip(raw, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
        counts = pd.DataFrame({"step": step, "label": [int(h[0]) for h in rows], "deciding": [False] * len(part.rows) + deciding})
        return counts.groupby(["step", "label", "deciding"]).size().reset_index(name="n")

    counted = per_part(findings, parts, work, "step long, label int, deciding boolean, n long").groupBy("step", "label", "deciding").agg(F.sum("n").alias("n"))
    held = counted.toPandas().sort_values(["step", "label", "deciding"])
    raw = held["step"].to_numpy() / STEPS
    net.scale = logistic_fit(raw[:, None], held["label"].to_numpy(float), held["n"].to_numpy(float)) if len(held) else np.array([1.0, 0.0])
    bare = held[held["deciding"]].assign(p=lambda x: 1 / (1 + np.exp(-np.clip(x["step"] / STEPS * net.scale[0] + net.scale[1], -30, 30)))).sort_values("p")
    upto = bare["n"].cumsum().to_numpy()
    net.threshold = float(bare["p"].iloc[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")]) if len(bare) else 0.5
    return net


def fit(found: DataFrame) -> Network | None:
    """A network from all candidates of ``found`` (doc_id, candidates); None where a label has none."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    at = F.xxhash64("doc_id", "start", "value", "kind").bitwiseAND(F.lit((1 << 62) - 1))
    findings = each.select((F.col("kind") != "wide").cast("int").alias("label"), "left", "value", "right", at.alias("at"))
    counts = {(r["label"], r["fold"]): r["count"] for r in findings.groupBy("label", (F.col("at") % 8).alias("fold")).count().collect()}
    both = lambda folds: len({label for label, fold in counts if fold in folds}) == 2
    if not both(ALL):
        return None
    parts = -(-sum(counts.values()) // PART)
    findings = written(findings.withColumn("part", F.pmod(F.shiftright("at", 8), F.lit(parts))), "findings")
    held = HELD if both(HELD) else ALL
    seen = ALL - HELD if both(ALL - HELD) else ALL
    # Each half is judged by a network that has not seen it, the held by the second half's.
    first, second = (calibrated(trained(findings, parts, half, []), findings, parts, held, []) if both(half) else None for half in HALVES)
    judges, held_judges = [(HALVES[0], second), (HALVES[1], first), (HELD, None)], [(ALL, second)]
    net = calibrated(trained(findings, parts, seen, judges), findings, parts, held, held_judges)
    # Where every other candidate looks like a confirmed value, none is left to learn from.
    return net or first or calibrated(trained(findings, parts, seen, []), findings, parts, held, [])


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with the candidates of each whole text; null and empty texts have none."""
    names = [c for c in docs.columns if c != "candidates"]
    text, out = names.index("text"), docs.select(*names)

    def work(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("value", pa.string()), ("right", pa.string())]))
        for batch in batches:
            found = [candidates(t) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "candidates"])

    schema = out.select("*", F.array().cast(f"array<{CANDIDATE}>").alias("candidates")).schema
    return map_batches(out, work, schema)


def spans_of(rows: list[list[dict]], net: Network | None) -> list[list[dict]]:
    """Spans (kind, start, end, score) of the candidates of some texts, in order."""
    each = [c for row in rows for c in row]
    score = net.probability([symbols(c["left"], c["value"], c["right"]) for c in each]) if net and each else [0.0] * len(each)
    scored, out = iter(zip(each, score)), []
    for row in rows:
        kept = []
        for c, p in (next(scored) for _ in row):
            if c["kind"] != "wide" or (net and p >= net.threshold):
                kept.append({"kind": c["kind"].replace("wide", "learned"), "start": c["start"], "end": c["end"], "score": float(p)})
        out.append(sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
    return out


def judged(found: DataFrame, net: Network | None) -> DataFrame:
    """``found`` with its candidates replaced by spans (kind, start, end, score), in order.

    Patterns' spans are all there, whatever their score; others if the network is sure.
    """
    shared = found.sparkSession.sparkContext.broadcast(net)
    at = found.columns.index("candidates")
    names = [*(c for c in found.columns if c != "candidates"), "spans"]

    def work(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            spans = spans_of(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names)

    span = "array<struct<kind:string,start:int,end:int,score:double>>"
    return map_batches(found, work, found.drop("candidates").select("*", F.array().cast(span).alias("spans")).schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text); offsets are code points.

    Candidates are written once to the shared folder, without the texts; the network learns
    from all of them and scores them all.  Without findings, or without other
    candidates, there is no network and the patterns stand alone.
    """
    found = written(find_candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    return judged(found, fit(found))


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by a mark of its kind; clean texts stay as they are.

    A keyword before a value goes with it; spans that overlap get the first one's mark.
    """
    net = fit(written(find_candidates(docs.select("doc_id", "text")).drop("text"), "candidates"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[text].to_pylist()
            spans = spans_of([candidates(t) if t else [] for t in texts], shared.value)
            columns[text] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(docs, work, docs.schema)


def redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
