"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the words with a digit or an ``@`` (no other word can be personal data of these kinds). Chain edges join
neighbouring nodes, skip edges join nodes of the document with the same key (its last seven digits, or the word itself),
so a number that is plain in one place and partial in another gets one label. Training is piecewise: node weights by a
softmax regression and edge potentials by counts, both from labels that the base patterns give over the whole corpus.
Inference is loopy sum-product on all documents of a chunk at once, with the labels of the base patterns given.

A key of seven digits or with an ``@`` names one person's datum. A word that the patterns miss, but with the key of a word
that they find in its document, is not an example of other: it is left out of all counts. Its skip edge goes straight to
the found word, and edges of such keys have a fixed potential ``AGREE`` for equal labels, as no counts can teach it. Keys of
fragments (a card's four digits, an area code) are shared by chance as well, so their potentials are counted.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.tables import free_name, id_and_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts, which the look-behind states to keep long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

MARKED = spans._mask(b"0123456789@")
TRIM = "()[]{}<>\"',.;:!?*#$%&|"
ROUNDS = 10
DAMPING = 0.5
SURE = 0.9
EDGE_LIMIT = 3.0
#: Log-odds for one label at both ends of a skip edge: chance gives two numbers of a document the same seven digits once in 10^7.
AGREE = 10.0
CHAIN, SKIP, FRAGMENT = range(3)
#: Score of the labels that a found word does not have: below the sum of any number of messages.
GIVEN = -1e9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    """Whether a run of digits, of any length, is a number up to 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def shape(word: str) -> tuple[int, ...]:
    """Discrete features of a word; their product bounds the number of shapes."""
    core = word.strip(TRIM)
    digits = _digits(core)
    n = len(digits)
    email = next(_emails(core), None)
    ip = IP.fullmatch(core)
    return (
        sum(n >= x for x in (1, 3, 4, 7, 9, 13, 20)),
        min(core.count("."), 4),
        2 if email == (0, len(core)) else int("@" in core),
        int(core.startswith("+")),
        int("-" in core),
        int(any(c.isalpha() for c in core)),
        int(13 <= n <= 19 and luhn(digits)),
        int(bool(ip) and all(len(p) < 4 and _octet(p) for p in core.split("."))),
        int(word.startswith("(") and word.endswith(")")),
    )


def key(word: str) -> str:
    core = word.strip(TRIM)
    digits = _digits(core)
    return digits[-7:] if len(digits) >= 7 and "@" not in core else core.lower()


def names_one(k: str) -> bool:
    """Whether words with this key are mentions of the same datum."""
    return "@" in k or len(_digits(k)) >= 7


class Document:
    """Nodes, edges and base labels of one document."""

    def __init__(self, text: str, words: list[tuple[int, int, int]]) -> None:
        """``words``: (start, end, number) of the words that are nodes."""
        self.base = base_spans(text)
        self.places = [(a, b) for a, b, _ in words]
        self.words = [text[a:b] for a, b, _ in words]
        self.shapes = [shape(w) for w in self.words]
        self.labels = [0] * len(words)
        starts = [a for a, _ in self.places]
        for k, a, b in reversed(self.base):
            for i in range(max(0, int(np.searchsorted(starts, a, "right")) - 1), len(words)):
                if starts[i] >= b:
                    break
                if self.places[i][1] > a:
                    self.labels[i] = k + 1
        numbers = [n for _, _, n in words]
        self.chain = [(i, i + 1) for i in range(len(words) - 1) if numbers[i + 1] == numbers[i] + 1]
        self.skip, self.fragment, last = [], [], {}
        keys = [key(w) for w in self.words]
        found = {k: i for i, k in reversed(list(enumerate(keys))) if self.labels[i] and names_one(k)}
        #: Missed by the patterns, but a mention of something that they find.
        self.missed = [not label and k in found for label, k in zip(self.labels, keys, strict=True)]
        chained = set(self.chain)
        for i, k in enumerate(keys):
            if self.missed[i]:
                self.skip.append((found[k], i))
            elif k in last and names_one(k):
                self.skip.append((last[k], i))
            elif k in last and (last[k], i) not in chained:
                self.fragment.append((last[k], i))
            last[k] = i

    @property
    def edges(self) -> list[tuple[int, int, int]]:
        """(from, to, kind) of all edges."""
        return [(i, j, what) for what, edges in ((CHAIN, self.chain), (SKIP, self.skip), (FRAGMENT, self.fragment)) for i, j in edges]


def read_documents(data: np.ndarray, bounds: np.ndarray) -> list[Document | None]:
    """The documents of a chunk; None where no word has a digit or an ``@``."""
    starts, ends, row = spans.words(data, bounds)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(MARKED[data], out=marks[1:])
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    nodes = np.flatnonzero(marks[ends] > marks[starts])
    cuts = np.searchsorted(row[nodes], np.arange(len(bounds)))
    out: list[Document | None] = [None] * (len(bounds) - 1)
    for r in np.unique(row[nodes]).tolist():
        own = nodes[cuts[r] : cuts[r + 1]]
        zero = points[bounds[r]]
        text = data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace")
        out[r] = Document(text, list(zip((points[starts[own]] - zero).tolist(), (points[ends[own]] - zero).tolist(), own.tolist(), strict=True)))
    return out


class Field:
    """Weights of the field: node scores by shape, and a potential for each pair of labels on chain and skip edges."""

    def __init__(self, counts: list[tuple[str, str, str, int]]) -> None:
        nodes = [(tuple(map(int, a.split(" "))), int(b), n) for what, a, b, n in counts if what == "node"]
        self.sizes = [8, 5, 3, 2, 2, 2, 2, 2, 2]
        x = np.stack([self.one_hot(s) for s, _, _ in nodes]) if nodes else np.zeros((0, sum(self.sizes) + 1))
        y = np.zeros((len(nodes), len(LABELS)))
        y[np.arange(len(nodes)), [b for _, b, _ in nodes]] = [n for _, _, n in nodes]
        self.weights = self._softmax(x, y)
        chain, fragment = (self._pairs([(int(a), int(b), n) for w, a, b, n in counts if w == what]) for what in ("chain", "fragment"))
        self.edges = np.stack([chain, AGREE * np.eye(len(LABELS)), fragment])

    def one_hot(self, s: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(sum(self.sizes) + 1)
        out[-1] = 1.0
        out[np.cumsum([0, *self.sizes[:-1]]) + np.array(s)] = 1.0
        return out

    @staticmethod
    def _softmax(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
        w = np.zeros((x.shape[1], y.shape[1]))
        if not len(x):
            w[-1, 0] = 10.0  # nothing seen: every node is other
            return w
        # Logarithmic weights keep rare kinds visible beside many plain numbers.
        y = np.log1p(y)
        total, square = y.sum(1, keepdims=True), np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            gradient = x.T @ (y - total * p / p.sum(1, keepdims=True)) / total.sum() - ridge * w
            square += gradient**2
            w += rate * gradient / np.sqrt(square + 1e-9)
        return w

    @staticmethod
    def _pairs(counts: list[tuple[int, int, int]]) -> np.ndarray:
        n = np.ones((len(LABELS), len(LABELS)))
        for a, b, c in counts:
            n[a, b] += c
        expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
        return np.clip(np.log(n / expected), -EDGE_LIMIT, EDGE_LIMIT)

    def marginals(self, shapes: list[tuple[int, ...]], edges: list[tuple[int, int, int]], given: list[int] | None = None) -> np.ndarray:
        """Label probabilities of every node after loopy message passing; edges are (from, to, kind).

        ``given``: the label that the base patterns give a node, 0 for none.
        """
        known: dict[tuple[int, ...], np.ndarray] = {}
        node = np.stack([known.setdefault(s, self.one_hot(s) @ self.weights) if s not in known else known[s] for s in shapes])
        node = node - np.logaddexp.reduce(node, 1, keepdims=True)
        if given is not None:
            fixed = np.flatnonzero(given)
            node[fixed] = GIVEN
            node[fixed, np.array(given)[fixed]] = 0.0
        belief = node
        if edges:
            a, b, what = np.array(edges).T
            psi = self.edges[what]
            right = np.zeros((len(a), len(LABELS)))
            left = np.zeros_like(right)
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, b, right)
                np.add.at(belief, a, left)
                to_right = np.logaddexp.reduce((belief[a] - left)[:, :, None] + psi, 1)
                to_left = np.logaddexp.reduce((belief[b] - right)[:, None, :] + psi, 2)
                right = DAMPING * right + (1 - DAMPING) * (to_right - np.logaddexp.reduce(to_right, 1, keepdims=True))
                left = DAMPING * left + (1 - DAMPING) * (to_left - np.logaddexp.reduce(to_left, 1, keepdims=True))
            belief = node.copy()
            np.add.at(belief, b, right)
            np.add.at(belief, a, left)
        return np.exp(belief - np.logaddexp.reduce(belief, 1, keepdims=True))


def train_field(docs: DataFrame) -> Field:
    """The field of a corpus. Counts over all documents; what reaches the driver is bounded by the number of shapes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, str]] = Counter()
        for chunk in spans.chunks(batches):
            for d in read_documents(*spans.text_bytes(chunk.column(0))):
                if d is None:
                    continue
                for s, label, missed in zip(d.shapes, d.labels, d.missed, strict=True):
                    if not missed:
                        seen["node", " ".join(map(str, s)), str(label)] += 1
                for what, edges in (("chain", d.chain), ("fragment", d.fragment)):
                    for i, j in edges:
                        if not d.missed[i] and not d.missed[j]:
                            seen[what, str(d.labels[i]), str(d.labels[j])] += 1
        what, a, b = ([k[i] for k in seen] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["what", "a", "b", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    return Field(sorted(tuple(r) for r in counts.collect()))


def added_spans(documents: list[Document | None], field: Field) -> list[list[tuple[int, int, int]]]:
    """Per document, spans of sure nodes that no base span touches."""
    shapes, edges, given, first = [], [], [], []
    for d in documents:
        first.append(len(shapes))
        if d is None:
            continue
        n = len(shapes)
        shapes += d.shapes
        given += d.labels
        edges += [(n + i, n + j, what) for i, j, what in d.edges]
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not shapes:
        return out
    p = field.marginals(shapes, edges, given)
    best, sure = p.argmax(1), p.max(1) >= SURE
    for d, n, found in zip(documents, first, out, strict=True):
        if d is None:
            continue
        for i, (a, b) in enumerate(d.places):
            if not best[n + i] or not sure[n + i] or d.labels[i]:
                continue
            word = d.words[i]
            a += len(word) - len(word.lstrip(TRIM))
            b -= len(word) - len(word.rstrip(TRIM))
            if a < b:
                found.append((int(best[n + i]) - 1, a, b))
    return out


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, of the first kind."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, field: Field | None = None, mask: bool = False) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with ``mask`` also masked_text.

    Counts and ``base_sha256`` are of the base spans, ``spans`` has those that the field adds as well. Null and empty texts
    have no spans; repeated rows repeat their result; columns besides doc_id and text are not read. ``field`` defaults to
    one trained on the same documents. A document is read whole in one row, so no group is ever gathered.
    """
    field = field or train_field(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"] + ["masked_text"] * mask

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(1))
            documents = read_documents(data, bounds)
            rows = []
            for r, (d, added) in enumerate(zip(documents, added_spans(documents, field), strict=True)):
                body = data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace") if mask else ""
                if d is None:
                    rows.append((0, 0, 0, 0, empty, "", body))
                    continue
                counts = Counter(k for k, _, _ in d.base)
                every = sorted(d.base + added)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(written(d.base).encode()).hexdigest(), written(every), masked(body, every) if mask else ""))
            types = [pa.int64()] * 4 + [pa.string()] * (2 + mask)
            columns = [pa.array([x[i] for x in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([chunk.column(0), *columns], names=names)

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked_text string" * mask
    return id_and_text(docs).mapInArrow(find, schema)


def mask_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with every span, base or added, replaced by its kind in brackets; all columns stay.

    ``n_chars``, if there is one, is that of the new text. A null text stays null.
    """
    field = field or train_field(docs)
    names = docs.columns
    at, body = names.index("text"), free_name(docs, "body")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in spans.chunks(batches, column=body):
            data, bounds = spans.text_bytes(chunk.column(chunk.num_columns - 1))
            documents = read_documents(data, bounds)
            texts = chunk.column(at).to_pylist()
            for r, (d, added) in enumerate(zip(documents, added_spans(documents, field), strict=True)):
                if d is not None and (d.base or added):
                    texts[r] = masked(texts[r], d.base + added)
            columns = list(chunk.columns[:-1])
            columns[at] = pa.array(texts, chunk.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.withColumn(body, F.coalesce("text", F.lit(""))).mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
