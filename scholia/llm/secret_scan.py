"""Secrets by patterns and a character network over candidates in context (operator 2).

The base patterns give findings of kinds assign, access and hex. Every other long run
of key characters with a digit (CANDIDATE), and every run of LEAST_ASSIGNED or more of them after
an assignment sign or a quote (ASSIGNED), is a candidate: all its characters and some around it go
through a small convolutional network (embedding of character and side, convolution, maximum over all
places of a candidate of any length, mean of its characters, one hidden layer).

The network is trained on two bounded samples from all documents (smallest hash), SAMPLE // 2 of the
candidates that a base finding labels and as many others. The base patterns know few shapes, so each
labelled finding is also shown in other shapes (SHAPES: other alphabets and lengths, drawn anew) and
other surroundings: its keyword masked by another word, in the place of an unlabelled candidate, or none. Words,
compounds and numbers from the table's own texts, put behind signs and quotes, are shown as clean. On a
calibration part a line turns the output into a probability, and the threshold is the largest, up to an
even chance, that still finds RECALL of the secrets there. Candidates above it that no base finding overlaps are
findings of kind model. held_out_shapes measures what it finds of a shape it has never seen.

Defined results: null or empty text has no findings; repeated rows each give a row; with
fewer than LEAST_FINDINGS labelled findings or others in all documents (an empty table too) there is no
network and only base findings are given; other columns are ignored. Very long texts and candidates are looked
at whole. Places count code points, ends are exclusive; findings are sorted by start, then kind as listed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import hash_sample, prepare, slices, stored, texts_of

KINDS = ("assign", "access", "hex", "model")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
ASSIGNED = re.compile(r"""(?:[:=]\x20*["']?|["'])([A-Za-z0-9+/_.=-]{6,})""")
DIGIT = re.compile(r"[0-9]")
SAMPLE, RECALL, LEAST_FINDINGS = 12_000, 0.95, 3
#: Characters around a candidate that are shown, and the most of its own that training shows (a scan shows all).
BEFORE, LEARNT, AFTER = 24, 64, 16
EMBEDDED, REACH, FILTERS, HIDDEN, EPOCHS = 8, 5, 24, 16, 8
#: Secrets and clean candidates that training aims at, and places that a task convolves at once.
SHOWN, PLACES = 6_000, 1 << 15
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Shapes in which a labelled finding is shown: alphabet, least and most length.
SHAPES = {
    "mixed": (LETTERS + LETTERS.upper() + "0123456789" * 2, 12, 48), "base64": (LETTERS + LETTERS.upper() + "0123456789+/", 20, 64),
    "upper": (LETTERS.upper() + "0123456789" * 2, 16, 32), "lower": (LETTERS + "0123456789" * 2, 12, 40), "hex": ("0123456789abcdef", 16, 64),
    "password": ("", 8, 24),
}
#: Words that stand for the keyword of an assignment.
MASKS = ("pwd", "pass", "auth", "credential", "login", "pin", "client_id", "private", "access", "key", "bearer", "cred")
KEYWORD = re.compile(r"(password|passwd|secret|token|api_?key)", re.IGNORECASE | re.ASCII)


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Long runs with a digit, and runs after an assignment sign or a quote that lie in no such run."""
    found = [m.span() for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])] if DIGIT.search(text) else []
    more, at = [], 0
    for m in ASSIGNED.finditer(text):
        begin, end = m.span(1)
        while at < len(found) and found[at][1] <= begin:
            at += 1
        if at == len(found) or found[at][0] >= end:
            more.append((begin, end))
    return sorted(found + more)


class Cover:
    """What some spans (sorted by start) cover together: whether another span meets it is one binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, begin: int, end: int) -> bool:
        i = bisect_right(self.ends, begin)
        return i < len(self.ends) and self.starts[i] < end


def shown(before: str, inside: str, after: str) -> np.ndarray:
    """Codes of the characters before, in and after a candidate; each side has its own."""
    parts = [np.frombuffer(x.encode("ascii", "replace"), np.uint8).astype(np.int64) + 128 * k for k, x in enumerate((before, inside, after))]
    return np.concatenate(parts)


def surroundings(text: str, begin: int, end: int) -> tuple[str, str, str]:
    return text[max(0, begin - BEFORE) : begin], text[begin:end], text[end : end + AFTER]


class Network(NamedTuple):
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def pooled(self, rows: list[np.ndarray]) -> np.ndarray:
        """Per candidate of any length: the maximum of each filter over all places, the mean embedding of its own characters, its length."""
        lengths = np.array([len(r) for r in rows])
        pad = np.zeros(REACH - 1, np.int64)
        flat = np.concatenate([x for r in rows for x in (r, pad)])
        heads = np.cumsum(lengths + REACH - 1) - (lengths + REACH - 1)
        of = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(len(of)) + np.repeat(heads - (np.cumsum(lengths) - lengths), lengths)  # places, without the padding
        peak, mean = np.full((len(rows), FILTERS), -np.inf), np.zeros((len(rows), EMBEDDED))
        own = np.zeros(len(rows))
        for k in range(0, len(at), PLACES):
            place, row = at[k : k + PLACES], of[k : k + PLACES]
            x = self.embedding[flat[place[:, None] + np.arange(REACH)]]
            conv = x.reshape(len(place), REACH * EMBEDDED) @ self.filters + self.filter_bias
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            peak[row[first]] = np.maximum(peak[row[first]], np.maximum.reduceat(conv, first, axis=0))
            inside = (flat[place] >= 128) & (flat[place] < 256)
            mean[row[first]] += np.add.reduceat(x[:, 0] * inside[:, None], first, axis=0)
            own[row[first]] += np.add.reduceat(inside.astype(float), first)
        return np.concatenate([np.maximum(peak, 0), mean / np.maximum(own, 1)[:, None], np.log1p(own)[:, None] / 4], axis=1)

    def output(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        mid = np.maximum(self.pooled(rows) @ self.hidden + self.hidden_bias, 0)
        return mid @ self.out[:-1] + self.out[-1]

    def chance(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.output(rows) + self.offset, -50, 50)))


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Network:
    """Adam on the logistic loss, both classes weighted alike."""
    rng = np.random.default_rng(seed)
    p = [
        rng.normal(0, 0.3, (3 * 128, EMBEDDED)), rng.normal(0, 0.2, (REACH * EMBEDDED, FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.3, (FILTERS + EMBEDDED + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN + 1),
    ]
    wide = max(len(r) for r in rows) + REACH - 1
    codes = np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        codes[i, : len(r)] = r
    lengths = np.array([len(r) for r in rows])
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    step, weight = 0, np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            c, n = codes[pick], len(pick)
            net = Network(*p)
            x = net.embedding[c]
            places = np.lib.stride_tricks.sliding_window_view(x, REACH, axis=1).swapaxes(2, 3).reshape(n, wide - REACH + 1, REACH * EMBEDDED)
            conv = places @ net.filters + net.filter_bias
            conv[np.arange(wide - REACH + 1)[None, :] >= lengths[pick][:, None]] = -np.inf
            peak = conv.argmax(axis=1)
            top = np.take_along_axis(conv, peak[:, None], axis=1)[:, 0]
            inside = (c >= 128) & (c < 256)
            own = np.maximum(inside.sum(axis=1), 1)
            active = np.concatenate([np.maximum(top, 0), (x * inside[:, :, None]).sum(axis=1) / own[:, None], np.log1p(inside.sum(axis=1))[:, None] / 4], axis=1)
            mid = np.maximum(active @ net.hidden + net.hidden_bias, 0)
            raw = mid @ net.out[:-1] + net.out[-1]
            error = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[pick]) * weight[pick] / n
            g_mid = np.outer(error, net.out[:-1]) * (mid > 0)
            g_active = g_mid @ net.hidden.T
            g_top = g_active[:, :FILTERS] * (top > 0)
            best = np.take_along_axis(places[:, :, :, None], peak[:, None, None, :], axis=1)[:, 0]
            g_embedding = np.zeros_like(p[0])
            back = np.einsum("nf,df->nfd", g_top, net.filters).reshape(n, FILTERS, REACH, EMBEDDED)
            for r in range(REACH):
                np.add.at(g_embedding, c[np.arange(n)[:, None], peak + r], back[:, :, r])
            which, at = np.nonzero(inside)
            np.add.at(g_embedding, c[which, at], (g_active[:, FILTERS : FILTERS + EMBEDDED] / own[:, None])[which])
            step += 1
            for i, g in enumerate([g_embedding, np.einsum("ndf,nf->df", best, g_top), g_top.sum(0), active.T @ g_mid, g_mid.sum(0), np.append(mid.T @ error, error.sum())]):
                first, second = moments[i]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p[i] = p[i] - 0.005 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Network(*[a.astype(np.float32) for a in p])


def calibrate(net: Network, rows: list[np.ndarray], labels: np.ndarray, recall: float = RECALL) -> Network:
    """A line from output to probability, and the largest threshold up to an even chance that keeps the recall."""
    from scholia.llm.quality_model import _line

    slope, offset = _line(net.output(rows).astype(float), labels.astype(float))
    net = net._replace(slope=slope, offset=offset)
    found = np.sort(net.chance(rows)[labels == 1])
    return net._replace(threshold=min(0.5, float(found[int((1 - recall) * len(found))])) if len(found) else 1.0)


def labelled(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a base finding overlaps it) of each candidate; base findings without one stand for themselves."""
    found, spans = base_findings(text), candidates(text)
    base, open_ = Cover([(a, b) for a, _, b in found]), Cover(spans)
    return [(a, b, base.meets(a, b)) for a, b in spans] + [(a, b, True) for a, _, b in found if not open_.meets(a, b)]


Window = tuple[str, str, str]


def secret(shape: str, words: list[str], rng: np.random.Generator) -> str:
    """A secret of a shape, drawn anew; passwords are words, digits and letters run together."""
    alphabet, low, high = SHAPES[shape]
    if shape == "password":
        parts = [str(rng.choice(words))[:8], str(rng.integers(0, 10_000)), "".join(rng.choice(list(LETTERS + LETTERS.upper()), rng.integers(2, 7)))]
        made = "".join(x.capitalize() if rng.random() < 0.5 else x for x in (parts[i] for i in rng.permutation(3)))
        return made + "".join(rng.choice(list("0123456789"), max(2, low - len(made))))
    made = "".join(rng.choice(list(alphabet), rng.integers(low, high + 1)))
    return made + "=" * int(rng.integers(0, 3)) if shape == "base64" else made


def examples(secrets: list[Window], others: list[Window], seed: int = 5) -> list[tuple[str, np.ndarray, int]]:
    """(shape, codes, label): the sampled candidates as they are, and what is made of them."""
    rng = np.random.default_rng(seed)
    words = sorted({w for x in (*secrets, *others) for side in (x[0], x[2]) for w in re.findall(r"[A-Za-z]{3,}", side)}) or ["word"]
    signs = [" = ", ": ", "=", ":", ' = "', ': "', '="', "'", '"', " "]

    def word() -> str:
        return str(rng.choice(words))

    def place() -> tuple[str, str]:
        """Surroundings of an unlabelled candidate, or a word of the texts with a sign."""
        before, _, after = others[rng.integers(len(others))]
        if rng.random() < 0.5:
            before = before[-10:] + " " + word() + signs[rng.integers(len(signs))]
            after = ('"' if before[-1] == '"' else "") + after
        return before, after

    rows = [("found", shown(a[-BEFORE:], x[:LEARNT], b), 1) for a, x, b in secrets] + [("found", shown(a, x[:LEARNT], b), 0) for a, x, b in others]
    shapes = sorted(SHAPES)
    for k in range(max(SHOWN - len(secrets), len(secrets))):
        before, _, after = secrets[k % len(secrets)]
        shape = shapes[k // len(secrets) % len(shapes)] if k >= len(secrets) else shapes[k % len(shapes)]
        style = rng.random()
        if style < 0.5:
            before = KEYWORD.sub(lambda m: str(rng.choice(MASKS)), before)
        elif style < 0.85:
            before, after = place()
        else:
            before = after = ""
        rows.append((shape, shown(before[-BEFORE:], secret(shape, words, rng)[:LEARNT], after[:AFTER]), 1))
    for k in range(max(SHOWN - len(others), len(others))):
        before, after = place()
        style = k % 4
        if style == 0:
            inside = word() + (word() if rng.random() < 0.3 else "")
        elif style == 1:
            inside = str(rng.choice(list(".-_/"))).join(word() + (str(rng.integers(0, 100)) if rng.random() < 0.3 else "") for _ in range(rng.integers(2, 5)))
        elif style == 2:
            inside = str(rng.choice(["", ".", "-", "/"])).join(str(rng.integers(0, 10_000)) for _ in range(rng.integers(2, 6)))
        else:
            inside = others[rng.integers(len(others))][1]
        if rng.random() < 0.2:
            before = before[: len(before) // 2] + " " + str(rng.choice(MASKS)) + signs[rng.integers(len(signs))]
        inside = inside if len(inside) >= LEAST_ASSIGNED else inside + word()
        rows.append(("clean", shown(before[-BEFORE:], inside[:LEARNT], after[:AFTER]), 0))
    return rows


def sampled(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[Window], list[Window]] | None:
    """Bounded samples of labelled findings and others from all documents; None where there are too few of either."""
    prepare(documents.sparkSession)
    most = max(sample // 2, LEAST_FINDINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[int, Window]]] = {True: [], False: []}
        seen = {True: 0, False: 0}
        for batch in slices(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for a, b, is_secret in labelled(text):
                    x, y, z = surroundings(text, a, b)
                    key = hashlib.blake2b(f"{i} {a} {x}{y}{z}".encode(), digest_size=8).digest()
                    held[is_secret].append((int.from_bytes(key, "big", signed=True), (x, y[:LEARNT], z)))
                    seen[is_secret] += 1
            for is_secret, rows in held.items():
                if len(rows) > 2 * most:
                    held[is_secret] = sorted(rows)[:most]  # the smallest of all tasks are among those of each
        rows = [(h, *w, k) for k in held for h, w in sorted(held[k])[:most]]
        first = {k: next((i for i, r in enumerate(rows) if r[4] == k), None) for k in held}
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        counted = pa.array([seen[r[4]] if first[r[4]] == i else 0 for i, r in enumerate(rows)], pa.int64())
        names = ["hash", "before", "inside", "after", "secret", "seen"]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], counted], names=names)

    schema = "hash long, before string, inside string, after string, secret boolean, seen long"
    found = stored(texts_of(documents).mapInArrow(run, schema), "secret-sample")
    seen = {r["secret"]: r["n"] for r in found.groupBy("secret").agg(F.sum("seen").alias("n")).collect()}  # two rows
    if min(seen.get(True, 0), seen.get(False, 0)) < LEAST_FINDINGS:
        return None
    parts = []
    for k in (True, False):
        rows = found.where(F.col("secret") == k).select("hash", "before", "inside", "after")
        parts.append([tuple(r)[1:] for r in hash_sample(rows, F.col("hash"), most, seen[k]).collect()])
    return parts[0], parts[1]


def fitted(rows: list[tuple[str, np.ndarray, int]]) -> Network:
    """Trained on two thirds of the examples, calibrated on the rest."""
    codes, labels = [r[1] for r in rows], np.array([r[2] for r in rows])
    held = np.arange(len(rows)) % 3 == 0
    part = lambda which: ([c for c, w in zip(codes, which) if w], labels[which])
    return calibrate(train(*part(~held)), *part(held))


def learn(documents: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from bounded samples of findings and others, or None where all documents together hold too few of either."""
    parts = sampled(documents, sample)
    return fitted(examples(*parts)) if parts else None


def held_out_shapes(documents: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """By shape: recall of a network that has never seen it, and its precision among as many clean examples not learnt from."""
    parts = sampled(documents, sample)
    out = {}
    for shape in SHAPES if parts else ():
        net = fitted([r for r in examples(*parts) if r[0] != shape])
        fresh = examples(*parts, seed=6)
        secrets, clean = [r[1] for r in fresh if r[0] == shape], [r[1] for r in fresh if r[0] == "clean"]
        clean = clean[: len(secrets)]
        hit, wrong = (net.chance(secrets) >= net.threshold).sum(), (net.chance(clean) >= net.threshold).sum()
        out[shape] = float(hit / len(secrets)), float(hit / max(hit + wrong, 1))
    return out


def _marked(text: str, findings: list[dict], mark: str) -> str:
    """The text with mark in place of each finding; findings that overlap become one mark."""
    pieces, at = [], 0
    for x in findings:
        if x["start"] >= at:
            pieces += [text[at : x["start"]], mark]
        at = max(at, x["end"])
    return "".join([*pieces, text[at:]])


def scan(documents: DataFrame, net: Network | None, keep: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """Per document: doc_id, the columns of keep, findings (array of kind, start, end); with mark, text is given redacted."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(net)  # some thousand weights
    kept = [f for f in documents.schema if f.name in keep and f.name not in ("doc_id", "text", "findings")]
    names = ["doc_id", *[f.name for f in kept], *(["text"] if "text" in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found, more = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found.append(base_findings(text))
                if network is not None:
                    base = Cover([(a, b) for a, _, b in found[i]])
                    more += [(i, a, b, shown(*surroundings(text, a, b))) for a, b in candidates(text) if not base.meets(a, b)]
            for k in range(0, len(more), 4096):
                part = more[k : k + 4096]
                for (i, a, b, _), chance in zip(part, network.chance([m[3] for m in part])):
                    if chance >= network.threshold:
                        found[i].append((a, 3, b))
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
            columns = {n: batch.column(n) for n in names}
            if mark is not None and "text" in columns:
                columns["text"] = pa.array([_marked(t, f, mark) for t, f in zip(columns["text"].to_pylist(), rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, kind)], names=[*names, "findings"])

    schema = "doc_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    schema += ("text string, " if "text" in keep else "") + "findings array<struct<kind:string,start:long,end:long>>"
    return texts_of(documents, *[f.name for f in kept]).mapInArrow(run, schema)


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of scan (with text kept), every finding replaced by mark; findings that overlap become one mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column("findings").to_pylist()):
                if found:
                    texts[i] = _marked(texts[i], found, mark)
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    prepare(scanned.sparkSession)
    return scanned.mapInArrow(run, scanned.schema)
