"""Personal data: base patterns, and a skip-chain conditional random field that adds the spans they miss.

Base patterns (email, ip, card, phone) hold whatever the model says. The model's variables are the tokens with a digit or
an at sign; all other tokens are certainly outside, so they split the chain and need no inference. Node potentials come
from hashed token, shape and context features; chain edges join neighbouring tokens. Tokens of one document that are equal or similar (same last seven digits, same mail
domain) are one entity; skip edges join each of them to the entity's hub, a variable without features, so two occurrences
are two edges apart however many there are and however far they stand from each other. Tokens inside base spans are
clamped to their kind, and so is the hub of an entity that has a whole token there. Loopy sum-product messages run over chain and skip edges of a whole batch of documents at once,
damped, until no message of a document changes by more than TOLERANCE; a document whose messages don't settle in MAX_ROUNDS,
with ever stronger damping, has its base spans alone and is flagged as such. Labels are decided by entity: when the hub or an occurrence reaches BELIEF in a kind, every
occurrence is of that kind, so labels agree across a document. Tokens that are no entity by themselves but may be a piece
of one (under seven digits, no at sign, no address: area codes, card blocks, but page numbers too) are decided where they
stand: by their own belief, or by their hub's beside a piece of that kind.

The model is trained here, on the driver, on TRAIN_DOCS documents that generate() labels by construction, by gradient
ascent on the likelihood with the messages' beliefs as expectations. It doesn't see the corpus.

Defined results: null and empty texts have no spans; repeated rows are each returned; very long texts are one document.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, unused

KINDS = ("email", "ip", "card", "phone")
N_LABELS = 1 + len(KINDS)  # 0: outside
DIM = 1 << 12
TOLERANCE = 1e-4
#: Messages keep so much of their last value, the more the longer they take to settle: (from this round on, share).
DAMP = ((0, 0.5), (200, 0.8), (1000, 0.95))
MAX_ROUNDS, ROUNDS_EACH = 10_000, 8
BELIEF = 0.95
TRAIN_DOCS, TRAIN_STEPS, SEED = 400, 120, 7
#: Gradients need less than labels.
TRAIN_TOLERANCE = 1e-2
#: Characters of the texts whose graphs a task holds at once; a longer text is one graph.
BATCH_CHARS = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_WS = re.compile(r"[\x20\x09-\x0D]")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|"
_BLANK = frozenset("\x20\t\n\v\f\r")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every at sign is looked at once: what may stand before it is taken back to the last match or another character."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """The model's variables: white-space tokens with a digit or an at sign."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        e = _WS.search(text, m.end())
        end = e.start() if e else len(text)
        out.append((start, end))
        at = end
    return out


#: Words that often stand before personal data.
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "reply", "courriel", "correo"},
    "ip": {"ip", "host", "server", "from", "address", "adresse", "gateway"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment"},
    "phone": {"call", "phone", "tel", "telephone", "fax", "mobile", "cell", "anruf", "appel", "llame", "ring"},
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}


def _shape(tok: str) -> str:
    """Of the whole token: letters in a row are one, digits in a row up to five, whole patterns of a long one too."""
    out = re.sub("[0-9]", "9", tok)
    out = re.sub(r"[^\W\d_]+", "a", out)
    out = re.sub(r"9{5,}", "9+", out)
    return re.sub(r"(.{2,12}?)\1{3,}", r"\1*", out)


def _beside(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether nothing but white space stands between a token and the next one."""
    m = _GAP.match(text, a[1])
    return bool(m) and m.end() == b[0]


def _word_before(text: str, at: int) -> str:
    """The word before a place, however far before; words are visited once each, so a text is read in step with its length."""
    while at and text[at - 1] in _BLANK:
        at -= 1
    end = at
    while at and text[at - 1] not in _BLANK:
        at -= 1
    return text[at:end]


def features(text: str, toks: list[tuple[int, int]]) -> list[list[int]]:
    out = []
    shapes = [_shape(text[a:b].strip(_EDGE)) for a, b in toks]
    near = [_beside(text, x, y) for x, y in zip(toks, toks[1:], strict=False)]
    for k, (a, b) in enumerate(toks):
        raw = text[a:b]
        tok = raw.strip(_EDGE)
        digits = "".join(c for c in tok if "0" <= c <= "9")
        f = ["bias", "shape=" + shapes[k], f"digits={min(len(digits), 20)}", f"dots={min(tok.count('.'), 5)}", f"at={tok.count('@')}"]
        f += [f"letters={any(c.isalpha() for c in tok)}", f"plus={raw[:1] == '+'}", f"paren={raw[:1] == '('}", f"dash={min(tok.count('-'), 4)}", f"long={b - a > 40}"]
        parts = tok.split(":")[0].split(".")
        f.append(f"octets={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        f.append(f"luhn={13 <= len(digits) <= 19 and luhn(digits)}")
        word = _word_before(text, a).strip(".,;:!?\"'()|#").lower()
        f.append("cue=" + _CUE.get(word, "-"))
        f.append(f"before={'version' if word in ('version', 'v', 'section', 'page', 'chapter', 'art') else '='if word == '=' else '-'}")
        left, right = k > 0 and near[k - 1], k + 1 < len(toks) and near[k]
        f.append(f"left={left} right={right}")
        if left:
            f.append("prev=" + shapes[k - 1])
        if right:
            f.append("next=" + shapes[k + 1])
        out.append([zlib.crc32(x.encode()) % DIM for x in f])
    return out


def _key(tok: str) -> str:
    return tok.strip(".,;:!?\"'()[]{}<>|").lower()


def edges(text: str, toks: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[bool, list[int]]]]:
    """Chain edges, and entities of two tokens or more: whether their tokens are all equal, and the tokens."""
    chain = [(k - 1, k) for k in range(1, len(toks)) if _beside(text, toks[k - 1], toks[k])]
    parent = list(range(len(toks)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first: dict[tuple[str, str], int] = {}
    texts = [_key(text[a:b]) for a, b in toks]
    for k, tok in enumerate(texts):
        digits = "".join(c for c in tok if "0" <= c <= "9")
        host = tok.partition("@")[2]
        for key in [("s", tok)] + [("d", digits[-7:])] * (len(digits) >= 7) + [("m", host)] * (host != ""):
            a, b = root(first.setdefault(key, k)), root(k)
            parent[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for k in range(len(toks)):
        members.setdefault(root(k), []).append(k)
    return chain, [(len({texts[k] for k in ks}) == 1, ks) for ks in members.values() if len(ks) > 1]


class Graph:
    """Variables and edges of a batch of documents, as arrays; a document's hubs follow its tokens."""

    def __init__(self):
        self.feats: list[list[int]] = []
        self.e: list[list[tuple[int, int]]] = [[], [], []]
        self.clamp: list[int] = []
        self.doc: list[int] = []

    def add(self, text: str, toks: list[tuple[int, int]], clamp: list[int]) -> tuple[int, list[list[int]]]:
        """(number of the first token's variable, tokens of each hub)."""
        at = len(self.feats)
        chain, hubs = edges(text, toks)
        self.feats += features(text, toks) + [[] for _ in hubs]
        self.e[0] += [(at + i, at + j) for i, j in chain]
        for h, (equal, ks) in enumerate(hubs):
            self.e[1 if equal else 2] += [(at + k, at + len(toks) + h) for k in ks]
        self.clamp += clamp + [self._held(text, toks, clamp, ks) for _, ks in hubs]
        self.doc += [self.doc[-1] + 1 if self.doc else 0] * (len(toks) + len(hubs))
        return at, [ks for _, ks in hubs]

    @staticmethod
    def _held(text: str, toks: list[tuple[int, int]], clamp: list[int], ks: list[int]) -> int:
        """An entity that base patterns know by a whole token, of one kind, is of that kind."""
        known = {clamp[k] for k in ks if clamp[k] >= 0 and _whole(_key(text[toks[k][0] : toks[k][1]]))}
        return known.pop() if len(known) == 1 else -1

    def arrays(self):
        n = len(self.feats)
        rows = np.repeat(np.arange(n), [len(f) for f in self.feats])
        cols = np.fromiter((c for f in self.feats for c in f), dtype=np.int64)
        ij = [np.array(e, dtype=np.int64).reshape(-1, 2) for e in self.e]
        kind = np.repeat(np.arange(3), [len(x) for x in ij])
        return n, rows, cols, np.concatenate(ij), kind, np.array(self.clamp, dtype=np.int64)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _messages(phi: np.ndarray, i: np.ndarray, j: np.ndarray, psi: np.ndarray, doc: np.ndarray, tolerance: float, unsettled: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Messages of all edges into j and into i. A document's stop when they have settled, so others in the batch don't change them; those that never do are added to unsettled."""
    fwd, bwd = np.zeros((len(i), N_LABELS)), np.zeros((len(i), N_LABELS))
    live, of, done = np.arange(len(i)), doc[i], 0
    while len(live):
        if done >= MAX_ROUNDS:
            unsettled.update(np.unique(of[live]).tolist())
            break
        damp = next(d for r, d in reversed(DAMP) if done >= r)
        ends, at = np.unique(np.r_[i[live], j[live]], return_inverse=True)
        a, b, own, p, f, g = at[: len(live)], at[len(live) :], phi[ends], psi[live], fwd[live], bwd[live]
        for _ in range(ROUNDS_EACH):
            node = own.copy()
            np.add.at(node, b, f)
            np.add.at(node, a, g)
            x = _lse((node[a] - g)[:, :, None] + p, 1)
            y = _lse((node[b] - f)[:, None, :] + p, 2)
            x -= _lse(x, 1)[:, None]
            y -= _lse(y, 1)[:, None]
            change = np.maximum(np.abs(x - f).max(axis=1), np.abs(y - g).max(axis=1))
            f, g = damp * f + (1 - damp) * x, damp * g + (1 - damp) * y
        fwd[live], bwd[live] = f, g
        worst = np.zeros(int(of.max()) + 1)
        np.maximum.at(worst, of[live], change)
        live = live[worst[of[live]] > tolerance]
        done += ROUNDS_EACH
    return fwd, bwd


def beliefs(w: np.ndarray, pair: np.ndarray, arrays, clamped: bool = True, doc: np.ndarray | None = None, tolerance: float = TOLERANCE, unsettled: set[int] | None = None):
    """(node beliefs, edge beliefs) by damped loopy sum-product, all messages at once; doc: the document of each variable."""
    n, rows, cols, ij, kind, clamp = arrays
    phi = np.zeros((n, N_LABELS))
    np.add.at(phi, rows, w[cols])
    if clamped and len(clamp):
        held = clamp >= 0
        phi[held] = -1e6  # more than any number of neighbours says
        phi[np.flatnonzero(held), clamp[held]] = 0.0
    i, j = ij[:, 0], ij[:, 1]
    psi = pair[kind]
    fwd, bwd = _messages(phi, i, j, psi, np.zeros(n, np.int64) if doc is None else doc, tolerance, set() if unsettled is None else unsettled)  # into j, into i
    node = phi.copy()
    np.add.at(node, j, fwd)
    np.add.at(node, i, bwd)
    both = (node[i] - bwd)[:, :, None] + (node[j] - fwd)[:, None, :] + psi
    both = np.exp(both - both.max(axis=(1, 2), keepdims=True)) if len(i) else both
    both = both / both.sum(axis=(1, 2), keepdims=True) if len(i) else both
    return np.exp(node - _lse(node, 1)[:, None]), both


def generate(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up document with (start, end, label) of its personal data, in forms that the base patterns know and don't know."""
    parts: list[str] = []
    found: list[tuple[int, int, int]] = []
    size = 0

    def say(s: str, label: int = 0) -> None:
        nonlocal size
        if label:
            found.append((size, size + len(s), label))
        parts.append(s + " ")
        size += len(s) + 1

    def words(n: int) -> None:
        for _ in range(n):
            say("".join(rng.choice("aeioulnrstdhm") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", ",", "."]))

    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = num(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    for _ in range(rng.randint(1, 6)):
        words(rng.randint(2, 8))
        kind = rng.randint(0, 9)
        cue = rng.random() < 0.4
        if kind == 0:
            if cue:
                say(rng.choice(sorted(CUES["email"])))
            name, host = f"{'user' + num(2)}@mail{num(1)}", rng.choice(["example", "host", "corp"])
            for form in rng.sample([f"{name}.{host}.com", f"{name}", f"{name}.{host}.org"], rng.randint(1, 2)):
                say(form, 1)
                words(2)
        elif kind == 1:
            if cue:
                say(rng.choice(sorted(CUES["ip"])))
            ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            for form in [ip, ip + ":" + num(4)][: rng.randint(1, 2)]:
                say(form, 2)
                words(2)
        elif kind == 2:
            if cue:
                say(rng.choice(sorted(CUES["card"])))
            c = card()
            for form in rng.sample([c, " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), "/".join(c[i : i + 4] for i in (0, 4, 8, 12))], rng.randint(1, 2)):
                say(form, 3)
                words(2)
        elif kind in (3, 4):
            if cue:
                say(rng.choice(sorted(CUES["phone"])))
            a, b, c = num(3), num(3), num(4)
            for form in rng.sample([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"], rng.randint(1, 3)):
                say(form, 4)
                words(2)
        else:
            for _ in range(rng.randint(1, 3)):
                say(rng.choice([num(rng.randint(1, 6)), str(rng.randint(1900, 2040)), f"Version {num(1)}.{num(1)}", f"${num(2)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"#{num(5)}", f"{num(2)}%", f"{num(1)}.{num(1)}.{num(1)}", f'"{num(4)}a{num(5)}bc{num(6)}"', num(rng.randint(8, 12)), f"{num(2)}/{num(2)}/{num(4)}", "@" + rng.choice(["home", "user", "all"]), num(20)]))
                words(1)
        words(rng.randint(0, 4))
    return "".join(parts), found


def train(n_docs: int = TRAIN_DOCS, steps: int = TRAIN_STEPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, pair potentials of chain, equal and similar edges)."""
    rng, g, gold = random.Random(seed), Graph(), []
    for _ in range(n_docs):
        text, found = generate(rng)
        toks = tokens(text)
        _, hubs = g.add(text, toks, [-1] * len(toks))
        own = [next((k for s, e, k in found if s <= a and b <= e + 1), 0) for a, b in toks]
        gold += own + [int(np.bincount([own[k] for k in ks]).argmax()) for ks in hubs]  # a hub is what most of its tokens are
    arrays, doc, y = g.arrays(), np.array(g.doc), np.array(gold)
    n, rows, cols, ij, kind, _ = arrays
    hot = np.eye(N_LABELS)[y]
    pair_hot = hot[ij[:, 0]][:, :, None] * hot[ij[:, 1]][:, None, :]
    w, pair = np.zeros((DIM, N_LABELS)), np.zeros((3, N_LABELS, N_LABELS))
    m = [np.zeros_like(w), np.zeros_like(pair)]
    v = [np.zeros_like(w), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        node, edge = beliefs(w, pair, arrays, clamped=False, doc=doc, tolerance=TRAIN_TOLERANCE)
        gw = np.zeros_like(w)
        np.add.at(gw, cols, (hot - node)[rows])
        gp = np.stack([(pair_hot - edge)[kind == k].sum(axis=0) for k in range(3)])
        gp[1:] = np.eye(N_LABELS) * np.trace(gp[1:], axis1=1, axis2=2)[:, None, None]  # one weight for agreement, whatever the label
        for x, grad, k in ((w, gw / n - 1e-4 * w, 0), (pair, gp / n - 1e-4 * pair, 1)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            x += 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, pair


_MODEL: list = []


def model() -> tuple[np.ndarray, np.ndarray]:
    """Trained once a driver; about 160 KB, whatever the corpus."""
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def find_spans(texts: list[str], w: np.ndarray, pair: np.ndarray, belief: float = BELIEF, unsettled: set[int] | None = None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of each text; one graph for all of them. Texts whose messages don't settle are added, by place, to unsettled and have no added spans."""
    out: list = [([], []) for _ in texts]
    g, where = Graph(), []
    for k, t in enumerate(texts):
        if not _MARK.search(t):
            continue
        base, toks = base_spans(t), tokens(t)
        clamp = [-1] * len(toks)
        spans = sorted((s, e, n) for n, s, e in base)
        for s, e, n in spans:
            for x in range(_first(toks, s), len(toks)):
                if toks[x][0] >= e:
                    break
                if clamp[x] < 0:
                    clamp[x] = 1 + KINDS.index(n)
        out[k] = (base, [])
        if all(c >= 0 for c in clamp):
            continue  # nothing is left to find
        where.append((k, *g.add(t, toks, clamp), toks, clamp))
    if not where:
        return out
    restless: set[int] = set()
    node, _ = beliefs(w, pair, g.arrays(), doc=np.array(g.doc), unsettled=restless)
    for k, at, hubs, toks, clamp in where:
        t = texts[k]
        if g.doc[at] in restless:
            if unsettled is not None:
                unsettled.add(k)
            continue
        label = _labels(t, toks, clamp, hubs, node[at : at + len(toks) + len(hubs)], belief)
        x = 0
        while x < len(toks):
            if clamp[x] >= 0 or not label[x]:
                x += 1
                continue
            y, digits = x, _digits(t, toks[x])
            while y + 1 < len(toks) and (digits := digits + _digits(t, toks[y + 1])) <= _MOST[label[x]] and label[y + 1] == label[x] and clamp[y + 1] < 0 and _beside(t, toks[y], toks[y + 1]):
                y += 1
            a, b = toks[x][0], toks[y][1]
            while a < b and t[a] in ".,;:!?\"'[]{}<>|":
                a += 1
            while a < b and t[b - 1] in ".,;:!?\"'([{<>|]}":
                b -= 1
            if a < b:
                out[k][1].append((KINDS[label[x] - 1], a, b))
            x = y + 1
    return out


def _whole(tok: str) -> bool:
    """Whether a token may be an entity by itself, not only a piece of one."""
    return "@" in tok or sum("0" <= c <= "9" for c in tok) >= 7 or tok.count(".") >= 3


def _labels(text: str, toks: list[tuple[int, int]], clamp: list[int], hubs: list[list[int]], node: np.ndarray, belief: float) -> list[int]:
    """The kind of each token, 0 for outside: by entity, for pieces by place. node: beliefs of the tokens, then of the hubs."""
    sure = np.where(node.max(axis=1) >= belief, node.argmax(axis=1), 0)
    label = [c if c >= 0 else int(x) for c, x in zip(clamp, sure, strict=False)]
    whole = [_whole(_key(text[a:b])) for a, b in toks]
    piece = [0] * len(toks)
    for h, ks in enumerate(hubs, len(toks)):
        free = [k for k in ks if clamp[k] < 0 and whole[k]]
        if free:
            best = node[[h, *free], 1:].max(axis=0)
            kind = 1 + int(best.argmax()) if best.max() >= belief else 0
            for k in free:
                label[k] = kind
        for k in ks:
            if not whole[k]:
                piece[k] = int(sure[h])
    order = range(len(toks))
    for way, step in ((order, -1), (reversed(order), 1)):
        for k in way:
            o = k + step
            if piece[k] and not label[k] and 0 <= o < len(toks) and label[o] == piece[k] and _beside(text, toks[min(k, o)], toks[max(k, o)]):
                label[k] = piece[k]
    return label


#: Digits of one entity of each label.
_MOST = (0, 0, 12, 19, 15)


def _digits(text: str, tok: tuple[int, int]) -> int:
    return sum("0" <= c <= "9" for c in text[tok[0] : tok[1]])


def _first(toks: list[tuple[int, int]], start: int) -> int:
    """The first token that ends after start."""
    lo, hi = 0, len(toks)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if toks[mid][1] <= start else (lo, mid)
    return lo


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about BATCH_CHARS at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    yield held


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind."""
    out, end = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"<{k.upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def detect(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, redacted: bool = False, belief: float = BELIEF) -> DataFrame:
    """carry's columns (doc_id by default), __base and __added (array of kind, start, end; code points), __settled (whether the model's part counts), and __redacted text if asked for.

    carry must have none of these names; the pipeline renames its columns for that.
    """
    w, pair = model()
    sent = docs.sparkSession.sparkContext.broadcast((w, pair))
    keep = carry or ["doc_id"]
    source = unused(keep, "__text")

    def run():
        w, pair = sent.value
        span = lambda found: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found]

        def make(texts: list) -> list:
            found, settled = [], []
            for part in _parts([t or "" for t in texts]):
                restless: set[int] = set()
                found += find_spans(part, w, pair, belief, restless)
                settled += [k not in restless for k in range(len(part))]
            new = [span(x for x, _ in found), span(y for _, y in found), settled]
            return new + [[None if t is None else redact(t, x + y) for t, (x, y) in zip(texts, found, strict=True)]] * redacted

        return make

    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(source))
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return appended(src, source, run, f"__base {kind}, __added {kind}, __settled boolean" + ", __redacted string" * redacted)


def op3(docs: DataFrame) -> DataFrame:
    found = detect(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    rank = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.transform(c, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("__base", "__added")).alias("spans"), F.size("__added").cast("bigint").alias("n_added"), F.col("__settled").alias("settled"))
