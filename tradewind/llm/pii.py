"""Personal data by rules and a skip-chain conditional random field, trained here on what the rules find."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fenced, fields_of, hashable, unfenced

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _CLUE, _NOT_DIGIT = re.compile("[0-9]"), re.compile("[0-9@]"), re.compile("[^0-9]")
#: Tried at the first digit of a run only, and never given back: a run without a dot behind it is read once.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    """As EMAIL.finditer, but trying only where an @ follows: a run without one is tried but once."""
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = at
        while start > pos and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            pos = m.end()
        else:
            pos = at + 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """As IP.finditer, in one pass over runs of dotted numbers: each four of a run are a match."""
    for m in _DOTTED.finditer(text):
        fields, start = m[0].split("."), m.start()
        for k in range(0, len(fields) - 3, 4):
            four = fields[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points by start, then kind; per kind leftmost, non-overlapping; failing matches are dropped."""
    out = [(m.start(), m.end(), 0) for m in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(s, e, 1) for s, e in _ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def clue_tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an @, without the punctuation around them.

    No other token can be of one of the kinds: the model holds it to "none", so that it parts the chain.
    """
    out, pos, n = [], 0, len(text)
    while m := _CLUE.search(text, pos):
        start = end = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        pos = end
        core = text[start:end]
        a, b = len(core) - len(core.lstrip("\"'([{<,;:!?.")), len(core.rstrip("\"')]}>,;:!?."))
        if a < b:
            out.append((start + a, start + b))
    return out


N_FEATURES = 24


def features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    f = np.zeros((len(tokens), N_FEATURES), np.float32)
    for row, (s, e) in zip(f, tokens, strict=True):
        token = text[s:e]
        digits = _NOT_DIGIT.sub("", token)
        n = len(digits)
        letters = any(c.isalpha() for c in token)
        fields = token.split(".")
        four = len(fields) == 4 and all(x.isdecimal() and x.isascii() for x in fields)
        at = token.find("@")
        row[0] = 1
        row[1] = at >= 0
        row[2] = 0 < at < token.rfind(".")
        row[3 + (n > 0) + (n > 3) + (n > 8) + (n > 11) + (n > 19)] = 1  # 3 to 8
        row[9] = 12 <= n <= 19 and not letters and luhn(digits)
        row[10] = 12 <= n <= 19 and not row[9]
        row[11] = four
        row[12] = four and all(len(x) <= 3 and int(x) <= 255 for x in fields)
        row[13] = token[0] == "+" or s > 0 and text[s - 1] == "+"
        row[14] = s > 0 and text[s - 1] == "(" and text[e : e + 1] == ")"
        row[15] = n >= 7 and "-" in token and not letters
        row[16] = letters
        row[17] = letters and token.isupper()
        row[18] = n == len(token)
        row[19] = any(c in "=\"'_/" for c in token)
        row[20] = n == 7 and len(token) == 8 and token[3] == "-"
        row[21] = text[max(0, s - 8) : s].rstrip(" (").endswith("+1")
        row[22] = n == 16 and not letters
        row[23] = n == 10 and not letters
    return f


def edges(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (only white space and brackets between), and skip edges: to the last token that is the same or similar.

    Similar tokens have equal letters and digits, the same last 7 digits of at least 7, or the same name before an @.
    """
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 4 and not text[tokens[i][1] : tokens[i + 1][0]].strip(" ()")]
    last: dict[str, int] = {}
    skip = []
    for i, (s, e) in enumerate(tokens):
        token = text[s:e]
        keys = ["=" + re.sub("[^0-9a-z@]", "", token.lower())] if e - s >= 5 else []
        if len(d := _NOT_DIGIT.sub("", token)) >= 7:
            keys.append(d[-7:])
        if token.find("@") >= 3:
            keys.append(token[: token.find("@") + 1].lower())
        for j in {last[k] for k in keys if k in last}:
            skip.append((j, i))
        last |= dict.fromkeys(keys, i)
    return chain, skip


def labels(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """0: none, else 1 + the kind of the first base span that the token meets; both lists are in order of their starts."""
    out = np.zeros(len(tokens), np.int64)
    ends = [e for _, e in tokens]
    for s, e, k in base:
        i = bisect_right(ends, s)
        while i < len(tokens) and tokens[i][0] < e:
            if not out[i]:
                out[i] = 1 + k
            i += 1
    return out


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> tuple:
    """The tokens of many documents as one graph: (document, start, end), features, labels, edges (from, to, type)."""
    at, fs, ys, es, n = [], [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)], [], 0
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        tokens = clue_tokens(text)
        if tokens:
            at += [(k, s, e) for s, e in tokens]
            fs.append(features(text, tokens))
            ys.append(labels(tokens, base))
            chain, skip = edges(text, tokens)
            es += [(n + i, n + j, 0) for i, j in chain] + [(n + i, n + j, 1) for i, j in skip]
            n += len(tokens)
    return at, np.concatenate(fs), np.concatenate(ys), np.array(es, np.int64).reshape(-1, 3)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def mentions(texts: list[str], seed: int = 1) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Training documents and their spans: those of the rules, and some told again in forms that the rules don't know.

    Each span may be repeated at the end of its document in another form, labelled as its kind, beside unrelated tokens of the
    same form, labelled none. So form alone doesn't tell; the link to what was found elsewhere does.
    """
    rng = np.random.default_rng(seed)
    out, golds = [], []
    for text in texts:
        gold = base_spans(text)
        for s, e, k in list(gold):
            if rng.random() < 0.5:
                continue
            core, other = text[s:e], "".join(str(rng.integers(10)) if c.isdecimal() else c for c in text[s:e])
            for word, mine in ((core, True), (other, False)):
                if k == 0:
                    name, host = word.split("@", 1)
                    word = f"{name if mine else name[::-1] + 'q'}@{host.split('.')[0]}"
                elif k == 1:
                    word = word.replace(".", "-")
                elif k == 2:
                    word = "_".join(re.findall("[0-9]{1,4}", word))
                else:
                    word = word[-8:]
                again = 1 + (rng.random() < 0.3)
                for _ in range(again):
                    text += " "
                    if mine:
                        gold.append((len(text), len(text) + len(word), k))
                    text += word + " so"
        out.append(text)
        golds.append(sorted(gold))
    return out, golds


def train(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the tokens (features x labels) and of the edges (type x label x label), by pseudo-likelihood.

    The labels are those of mentions(); each token is predicted from its features and its neighbours' labels.
    """
    n_labels = 1 + len(KINDS)
    w, v = np.zeros((N_FEATURES, n_labels)), np.zeros((2, n_labels, n_labels))
    _, f, y, e = graph(*mentions(texts))
    if not len(y):
        return w, v
    one = np.eye(n_labels)[y]
    near = np.zeros((2, len(y), n_labels))  # neighbours' labels, by type of the edge
    for kind in (0, 1):
        i, j = e[e[:, 2] == kind, 0], e[e[:, 2] == kind, 1]
        np.add.at(near[kind], i, one[j])
        np.add.at(near[kind], j, one[i])
    gw, gv = np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    for _ in range(steps):
        miss = softmax(f @ w + near[0] @ v[0] + near[1] @ v[1]) - one
        dw = f.T @ miss / len(y) + decay * w
        dv = np.stack([near[k].T @ miss / len(y) for k in (0, 1)])
        dv = (dv + dv.transpose(0, 2, 1)) / 2 + decay * v
        gw += dw**2
        gv += dv**2
        w -= rate * dw / np.sqrt(gw)
        v -= rate * dv / np.sqrt(gv)
    return w, v


def beliefs(node: np.ndarray, e: np.ndarray, v: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of all tokens by loopy sum-product message passing."""
    n_labels = node.shape[1]
    source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    pot = v[np.concatenate([e[:, 2], e[:, 2]])]
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    told = np.zeros((len(source), n_labels))
    for _ in range(rounds if len(e) else 0):
        total = node.copy()
        np.add.at(total, target, told)
        out = (total[source] - told[back])[:, :, None] + pot
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        told = damping * told + (1 - damping) * (new - new.max(1, keepdims=True))
    total = node.copy()
    np.add.at(total, target, told)
    return softmax(total)


def all_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray], sure: float) -> list[list[tuple[int, int, int, bool]]]:
    """(start, end, kind, base) per text: base spans, then what the model adds beside them."""
    bases = [base_spans(t) for t in texts]
    out = [[(*s, True) for s in b] for b in bases]
    w, v = model
    at, f, y, e = graph(texts, bases)
    if not len(at) or not w.any():
        return out
    node = f.astype(np.float64) @ w
    node[np.arange(len(y)), y] += 20 * (y > 0)  # what the rules found is evidence
    p = beliefs(node, e, v)
    kind = p[:, 1:].argmax(1)
    for i in np.flatnonzero((y == 0) & (p[np.arange(len(kind)), kind + 1] >= sure)).tolist():
        doc, s, t = at[i]
        own = out[doc]
        if own and not own[-1][3] and own[-1][2] == kind[i] and s - own[-1][1] <= 4 and not texts[doc][own[-1][1] : s].strip(" ()-"):
            s = own.pop()[0]
        own.append((s, t, int(kind[i]), False))
    return [sorted(x, key=lambda s: (s[0], s[2], s[1])) for x in out]


def redact(text: str, spans: list[tuple]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in angle brackets."""
    out, pos, k = [], 0, 0
    while k < len(spans):
        s, e, kind = spans[k][:3]
        k += 1
        while k < len(spans) and spans[k][0] < e:
            e = max(e, spans[k][1])
            k += 1
        out += [text[pos:s], f"<{KINDS[kind].upper()}>"]
        pos = e
    return "".join([*out, text[pos:]])


def find_personal_data(docs: DataFrame, text: str = "text", train_docs: int = 6000, sure: float = 0.9, redacted: bool = False) -> DataFrame:
    """Every row without its text, with n_email, n_ip, n_card, n_phone (base spans), spans (all, with a flag for base ones), and
    the text with all spans replaced (column ``redacted``) if asked for.

    Rules find the base spans. Tokens with digits or an @ form a graph per document: neighbours are chained, and repeated or
    similar tokens are linked over any distance. The model is fitted on the driver from those of train_docs documents (with the
    smallest hashes) that hold a digit or an @, labelled by the rules and by mentions(). Loopy message passing then labels every document; tokens
    with a kind at probability ``sure`` or more become further spans.

    Null and empty texts have no spans (a null text stays null when redacted). Repeated rows get the same result; an empty
    table gives an empty result. Columns named like a result are replaced, all others carried along, whatever their names.
    """
    added = [f"n_{k}" for k in KINDS] + ["spans"] + ["redacted"] * redacted
    rows, inner, outer = fenced(docs, {text: "text"}, (text, *added))
    body = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    sample = bounded_sample(rows.filter(F.col("text").isNotNull()), train_docs, F.xxhash64("text", *hashable(rows, inner)), body)
    model = train([r.x for r in sample if r.x])
    fields = [*fields_of(rows, inner), *(f"n_{k} long" for k in KINDS), f"spans {SPANS}"] + ["redacted string"] * redacted
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            found = [x for part in _graph_runs([t or "" for t in raw]) for x in all_spans(part, model, sure)]
            counts = [pa.array([sum(s[2] == k and s[3] for s in x) for x in found], pa.int64()) for k in range(len(KINDS))]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in x] for x in found], kind_of)
            more = [pa.array([None if t is None else redact(t, x) if x else t for t, x in zip(raw, found, strict=True)], pa.string())] if redacted else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts, spans, *more], names=[*inner, *added])

    return unfenced(rows.select("text", *inner).mapInArrow(run, ", ".join(fields)), inner, outer, added)


def _graph_runs(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters, so that a graph is of few texts where these are long."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
