"""Secret scans: three base patterns, and formats learnt by grammar inference.

Labelled credentials of each format become a prefix tree. States are merged
where what follows them is statistically compatible (Hoeffding bounds on every
next character, on kinds of characters and on how much of the string is left,
at every pair of states that the merge folds together), which gives a
probabilistic automaton per format: literals and lengths stay where the
examples fix them, and become loops where they vary. Every run of credential
characters is read once, left to right, by all automata: each place where a
format may begin starts a hypothesis, and each place where one may end scores
it. A candidate is a secret where its format explains it better than any
automaton of harmless strings.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import lean
from .shingles import split_words, text_bytes

# The base patterns, and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex")
#: A text without a match of this has no base span.
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

_U, _L, _D = string.ascii_uppercase, string.ascii_lowercase, string.digits
_HEX, _ALNUM, _URL = _D + "abcdef", _U + _L + _D, _U + _L + _D + "_-"

_JWT_HEADERS = tuple(
    base64.urlsafe_b64encode(json.dumps(header, separators=(",", ":")).encode()).decode().rstrip("=")
    for alg in ("HS256", "RS256", "ES256")
    for header in ({"alg": alg, "typ": "JWT"}, {"typ": "JWT", "alg": alg})
)

# Public credential formats as parts (literals to choose from, alphabet, least and greatest length).
SECRET_FORMATS = {
    "aws": [(("AKIA", "ASIA"), _U + _D, 16, 16)],
    "github": [(("ghp_", "gho_", "ghu_", "ghs_"), _ALNUM, 36, 36)],
    "slack": [(("xoxb-", "xoxp-"), _D, 10, 13), (("-",), _D, 10, 13), (("-",), _ALNUM, 24, 32)],
    "stripe": [(("sk_live_", "sk_test_", "rk_live_"), _ALNUM, 24, 34)],
    "google": [(("AIza",), _URL, 35, 35)],
    "gitlab": [(("glpat-",), _URL, 20, 20)],
    "npm": [(("npm_",), _ALNUM, 36, 36)],
    "sendgrid": [(("SG.",), _URL, 22, 22), ((".",), _URL, 43, 43)],
    "jwt": [(_JWT_HEADERS, "", 0, 0), ((".eyJ",), _URL, 30, 120), ((".",), _URL, 43, 43)],
    "key40": [(("",), _ALNUM + "+/", 40, 40)],
}
# Harmless formats, so that ids, digests, numbers and words don't look like keys.
PLAIN_FORMATS = {
    "number": [(("",), _D, 8, 40)],
    "hex": [(("",), _HEX, 8, 64)],
    "upper_hex": [(("",), _D + "ABCDEF", 8, 64)],
    "uuid": [(("",), _HEX, 8, 8), (("-",), _HEX, 4, 4), (("-",), _HEX, 4, 4), (("-",), _HEX, 4, 4), (("-",), _HEX, 12, 12)],
    "lower": [(("",), _L, 4, 40)],
    "upper": [(("",), _U, 4, 40)],
    "camel": [(("",), _L, 3, 9)] + [(tuple(_U), _L, 2, 9)] * 4,
    "upper_number": [(("",), _U, 2, 8), (("-", "_"), _D, 4, 24)],
    "lower_number": [(("",), _L, 4, 24), (("", "-", "_"), _D, 1, 16)],
    "path": [(("", "/"), _L, 2, 9)] + [(("/", "."), _L + _D, 2, 12)] * 4,
    "joined": [(("",), _L, 2, 9)] + [(("_", "-", "."), _L + _D, 1, 9)] * 4,
}


def _examples(formats: dict, n: int, seed: int) -> dict[str, list[str]]:
    out = {}
    for name, parts in formats.items():
        rng = random.Random(f"{seed}:{name}")
        out[name] = ["".join(rng.choice(literals) + "".join(rng.choices(alphabet, k=rng.randint(low, high))) for literals, alphabet, low, high in parts) for _ in range(n * (1 + sum(high - low for _, _, low, high in parts) // 30))]
    return out


def labelled(n: int = 300, seed: int = 7) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(credentials, harmless strings) by format, ``n`` of each and more where lengths vary much, the same on every call."""
    return _examples(SECRET_FORMATS, n, seed), _examples(PLAIN_FORMATS, n, seed)


#: Marks that come in pairs, in the two alphabets of 64 characters.
_MARKS = {"-": "-_", "_": "-_", "+": "+/", "/": "+/"}


def _kind(c: str) -> str:
    return "U" if c in _U else "L" if c in _L else "D" if c in _D else c


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible prefix-tree states."""

    END = ""
    #: Distinct characters of a kind (or three times so many of all kinds) that a state must have met before it takes the others of its kinds too.
    OPEN = 3
    #: Log probability of a character that an open state hasn't met.
    RARE = -7.0
    #: Strings after which a state's range of what is left, and a literal, is known.
    KNOWN = 20

    def __init__(self, strings: list[str], alpha: float = 0.02):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.left: list[Counter] = [Counter()]  # strings by how many characters follow
        self.depth, self.via = [0], [""]
        for s in strings:
            at = 0
            for k, c in enumerate(s):
                self.count[at][c] += 1
                self.left[at][len(s) - k] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.left.append(Counter())
                    self.depth.append(k + 1)
                    self.via.append("" if c in _URL or c in "+/" else c)
                at = self.next[at][c]
            self.count[at][self.END] += 1
            self.left[at][0] += 1
        self.size = [c.total() for c in self.count]
        self.shortest = min(map(len, strings))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        # Characters are many tests at once: the bound holds for all of them together.
        self.many = math.sqrt(math.log(2 * len({c for n in self.count for c in n}) / alpha) / math.log(2 / alpha))
        self._merge()
        self._compile()
        # Only what reads strings is kept: the tree of all examples would take fifty times as much in every worker.
        del self.next, self.count, self.left, self.size, self.depth, self.via, self.red

    def _same(self, a: int, b: int) -> bool:
        """Whether two states' own statistics are compatible."""
        n, m = self.size[a], self.size[b]
        if max(n, m) >= self.KNOWN:
            large, small = (a, b) if n >= m else (b, a)
            if min(self.left[small]) > max(self.left[large]) or max(self.left[small]) < min(self.left[large]):
                return False
            if len(self.count[large]) < self.OPEN and not self.count[small].keys() <= self.count[large].keys():
                return False
        reach = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if reach >= 1:
            return True
        x, y = self.count[a], self.count[b]
        if any(abs(x[c] / n - y[c] / m) > reach * self.many for c in {*x, *y}):
            return False
        kinds: dict[str, float] = defaultdict(float)
        for c in {*x, *y}:
            kinds[_kind(c)] += x[c] / n - y[c] / m
        if any(abs(d) > reach for d in kinds.values()):
            return False
        gap = 0.0
        for k in sorted({*self.left[a], *self.left[b]}):
            gap += self.left[a][k] / n - self.left[b][k] / m
            if abs(gap) > reach:
                return False
        return True

    def _alike(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if a == b or pair in seen:
                continue
            seen.add(pair)
            if not self._same(a, b):
                return False
            todo += [(t, self.next[b][c]) for c, t in self.next[a].items() if c in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> list[tuple[int, str, int]]:
        """Add the tree below ``b`` to state ``a``; the transitions (state, character, next) that are new."""
        todo, new = [(a, b)], []
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            self.left[a].update(self.left[b])
            self.size[a] += self.size[b]
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t
                    new.append((a, c, t))
        return new

    def _merge(self) -> None:
        """Red states stay; of the blue ones the most frequent of the least depth is next.

        It takes in its compatible sisters (by letters and digits), and goes to the compatible red state of the nearest
        depth. Few strings are compatible with anything, so a state of few goes only to one that a like character led to.
        """
        red, blue = [0], {t: (0, c) for c, t in self.next[0].items()}
        while blue:
            b = min(blue, key=lambda t: (self.depth[t], -self.size[t], t))
            r, c = blue.pop(b)
            if _kind(c) in "ULD":
                for t in [t for t, (q, d) in blue.items() if q == r and _kind(d) in "ULD"]:
                    if self._alike(b, t):
                        self.next[r][blue.pop(t)[1]] = b
                        self._fold(b, t)
            known = self.size[b] >= self.KNOWN
            near = sorted((abs(self.depth[q] - self.depth[b]), q) for q in red if not known or self.size[q] >= self.KNOWN)
            if not known:  # what was reached by a like character comes first
                near = sorted((self.via[q] != self.via[b], d, q) for d, q in near)
                near = [(d, q) for other, d, q in near if not other]
            to = next((q for _, q in near if self._alike(q, b)), None)
            if to is None:
                red.append(b)
                blue |= {t: (b, c) for c, t in self.next[b].items()}
            else:
                for d in [d for d, t in self.next[r].items() if t == b]:
                    self.next[r][d] = to
                for q, d, t in self._fold(to, b):
                    if q in red:
                        blue[t] = (q, d)
        self.red = red

    def _compile(self) -> None:
        """``go[state][character]``: (next state, log probability), or None where no example could go; ``end[state]``: log probability of the end."""
        place = {q: k for k, q in enumerate(self.red)}
        met = {c for q in self.red if len(self.next[q]) >= 3 * self.OPEN for c in self.next[q] if _kind(c) in "ULD" or c in _MARKS}
        loose = {d for c in met for d in {"U": _U, "L": _L, "D": _D}.get(_kind(c), c)}
        self.go: list[dict[str, tuple[int, float]]] = []
        self.end: list[float | None] = []
        for q in self.red:
            total = self.count[q].total()
            by_kind: dict[str, list[str]] = defaultdict(list)
            for c in self.next[q]:
                by_kind[_kind(c)].append(c)
            go = {}
            for kind, met in list(by_kind.items()):
                every = {"U": _U, "L": _L, "D": _D}.get(kind, met) if len(met) >= self.OPEN or len(self.next[q]) >= 3 * self.OPEN else met
                if kind in _MARKS and len(self.next[q]) >= 3 * self.OPEN:
                    every = _MARKS[kind]  # among letters and digits, a mark's twin too
                usual = place[Counter({self.next[q][c]: self.count[q][c] for c in met}).most_common(1)[0][0]]
                own = sum(self.count[q][c] for c in met)
                for c in every:
                    p = (self.count[q][c] + 0.5) / (own + 0.5 * len(every)) * own / total
                    if c in go and c not in met:
                        continue
                    go[c] = (place[self.next[q][c]] if c in self.next[q] else usual, math.log(p))
            if len(self.next[q]) >= 3 * self.OPEN:  # an open state: other letters, digits and paired marks of the format are rare, not impossible
                usual = place[Counter({self.next[q][c]: self.count[q][c] for c in self.next[q]}).most_common(1)[0][0]]
                go = {c: (usual, self.RARE) for c in loose} | go
            self.go.append(go)
            self.end.append(math.log(self.count[q][self.END] / total) if self.count[q][self.END] else None)
        self.alphabet = {c for go in self.go for c in go}
        self.literal = max(self.count[0].values()) >= self.count[0].total() / 8 or len(self.go[0]) < 8
        least, at = 0, {0}
        while not any(self.end[q] is not None for q in at):
            least, at = least + 1, {t for q in at for t, _ in self.go[q].values()}
        #: No shorter string is a candidate: what is accepted, and what was labelled, is at least so long.
        self.least = max(least, self.shortest)

    def log_likelihood(self, s: str) -> float:
        """Log probability of the string and its end; minus infinity if it isn't accepted."""
        at, total = 0, 0.0
        for c in s:
            if c not in self.go[at]:
                return -math.inf
            at, p = self.go[at][c]
            total += p
        return -math.inf if self.end[at] is None else total + self.end[at]

    def log_likelihood_with_gaps(self, s: str, floor: float = -7.0) -> float:
        """The same, where a character that doesn't fit costs ``floor`` and keeps the state."""
        at, total = 0, 0.0
        for c in s:
            at, p = self.go[at].get(c, (at, floor))
            total += p
        return total + (floor if self.end[at] is None else self.end[at])

    def may_begin(self, before: str) -> bool:
        return not (before in _ALNUM if self.literal else before in self.alphabet) if before else True

    def may_end(self, after: str) -> bool:
        return self.may_begin(after)


def train(credentials: dict[str, list[str]], harmless: dict[str, list[str]]) -> tuple[dict[str, Automaton], dict[str, Automaton]]:
    """An automaton for each format of both."""
    return {k: Automaton(v) for k, v in credentials.items()}, {k: Automaton(v) for k, v in harmless.items()}


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, Automaton], dict[str, Automaton]]:
    """The automata of ``labelled``."""
    return train(*labelled())


def is_secret(score: float, candidate: str, plain: dict[str, Automaton], margin: float = 5.0) -> bool:
    """Whether a format's log likelihood beats every harmless automaton by ``margin``."""
    return all(score >= a.log_likelihood_with_gaps(candidate) + margin for a in plain.values())


def scan_run(run: str, secret: dict[str, Automaton], plain: dict[str, Automaton]) -> list[tuple[str, int, int]]:
    """(format, start, end) of the secrets in a run of credential characters, leftmost and then longest first, without overlaps.

    One pass: an automaton holds one hypothesis per state, the one that began first.
    """
    found: list[tuple[int, int, float, str]] = []
    for name, a in secret.items():
        live: dict[int, tuple[int, float]] = {}
        for k, c in enumerate(run):
            if len(run) - k >= a.least and c in a.go[0] and a.may_begin(run[k - 1] if k else ""):
                live[0] = min(live.get(0, (k, 0.0)), (k, 0.0))
            after: dict[int, tuple[int, float]] = {}
            for q, (start, p) in live.items():
                if c in a.go[q]:
                    t, more = a.go[q][c]
                    if t not in after or start < after[t][0]:
                        after[t] = (start, p + more)
            live = after
            if live and a.may_end(run[k + 1] if k + 1 < len(run) else ""):
                for q, (start, p) in live.items():
                    if a.end[q] is not None and k + 1 - start >= a.least and is_secret(p + a.end[q], run[start : k + 1], plain):
                        found.append((start, -(k + 1), -(p + a.end[q]), name))
    out: list[tuple[str, int, int]] = []
    for start, end, _, name in sorted(found):
        if not out or start >= out[-1][2]:
            out.append((name, start, -end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the base patterns find, by start and then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: Candidates lie in runs of these bytes.
_OTHER = np.ones(256, bool)
_OTHER[[ord(c) for c in _URL + "+/=."]] = False


def runs(column: pa.Array, least: int) -> dict[int, list[tuple[int, int]]]:
    """Byte spans of the runs of at least ``least`` credential characters by text."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return {}
    starts, ends = split_words(raw, offsets, _OTHER)
    keep = ends - starts >= least
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    owner = np.searchsorted(offsets, starts[keep], side="right") - 1
    for t, a, b in zip(owner.tolist(), (starts[keep] - offsets[owner]).tolist(), (ends[keep] - offsets[owner]).tolist()):
        out[t].append((a, b))
    return out


def _show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scan_secrets(docs: DataFrame, credentials: dict[str, list[str]] | None = None, harmless: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``credentials`` and ``harmless`` are labelled strings by format; without
    them those of ``labelled`` are used. Offsets are code points, end exclusive,
    over the whole text. The learnt formats add spans (kind ``format_NAME``)
    only outside the base ones. Runs shorter than any string that an automaton
    accepts hold none and are passed over; no other run is. A null text is empty
    and has no spans; repeated rows give repeated rows; other columns are not
    read; an empty table gives none. Every row stands alone: nothing is shuffled.
    """
    known = trained() if credentials is None and harmless is None else train(credentials or labelled()[0], harmless or labelled()[1])
    shared = docs.sparkSession.sparkContext.broadcast(known)
    least = min(a.least for a in known[0].values())

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                column = batch.column("text")
                found = runs(column, least)
                todo = set(np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, MAYBE), False).to_numpy(zero_copy_only=False)).tolist()) | set(found)
                n = batch.num_rows
                counts, digest, spans = np.zeros((3, n), np.int64), [none] * n, [""] * n
                for t in sorted(todo):
                    text = column[t].as_py()
                    base = base_spans(text)
                    for kind, *_ in base:
                        counts[KINDS.index(kind), t] += 1
                    digest[t] = hashlib.sha256(_show(base).encode()).hexdigest() if base else none
                    more, data, seen, start = [], text.encode() if t in found else b"", 0, 0
                    for a, b in found.get(t, ()):
                        start, seen = start + len(data[seen:a].decode()), a
                        for name, x, y in scan_run(data[a:b].decode(), *shared.value):
                            if not any(p < start + y and start + x < q for _, p, q in base):
                                more.append((f"format_{name}", start + x, start + y))
                    spans[t] = _show(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c) for c in counts], pa.array(digest), pa.array(spans)], _OUT)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
