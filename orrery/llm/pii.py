"""Personal data: fixed base patterns, and a semi-Markov conditional random field around them.

The field labels whole segments of at most ``REACH`` tokens.  A segment's
features look at all of it at once: its shape, digit groups, separators, check
sums, and the words before it.  Weights are learned by gradient ascent on the
conditional likelihood of seeded, generated sentences; decoding is dynamic
programming over end positions and types, with segments bounded in tokens and
digits, so boundaries and types are chosen jointly.  Segments of like
characters, digits standing for any digit, are scored once a worker.  It runs in the windows around digits and ``@``,
the only places where its types can begin.  Its segments that no base finding
overlaps are added.

Defined results: null text counts as empty and has no findings; equal rows give
equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import lean_batches, tidy

Span = tuple[int, int, str]  # start, end, kind

# The kinds and patterns of the contract.
BASE = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: the search from the run's first digit would have taken it
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ADDED = ("ssn", "iban")
KINDS = (*BASE, *ADDED)
ORDER = {k: i for i, k in enumerate(KINDS)}
REACH = 14
BEFORE, AFTER = 48, 48
OUTSIDE = "O"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Findings of the fixed patterns, by start and kind."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


# --- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]")
_CUES = {
    "email": {"mail", "email", "contact"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "credit", "debit", "mastercard"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "telephone", "cell"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank"},
}


#: Digits and letters by class, as all features but the checks of digits see them.
_CLASS = str.maketrans({c: "0" for c in "0123456789"} | {chr(c): "a" if c > 96 else "A" for c in (*range(65, 91), *range(97, 123))})
#: Digits of the longest entity, by whether it starts with a letter (an IBAN) or not (a card).
MOST_DIGITS = {True: 34, False: 19}
#: Scores of segments that a worker keeps; beyond that it starts anew.
CACHED_SCORES = 50_000


def _kind(t: str) -> str:
    return "d" if t[0] in "0123456789" else "a" if t[0].isalpha() else t


def _touching(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else c


def own_features(text: str) -> list[str]:
    """Of a segment by itself; all but ``checks`` see the classes of its characters only."""
    groups = [len(g) for g in re.findall("[0-9]+", text)]
    shape = re.sub(r"(.)\1+", r"\1+", "".join("d" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in text))
    signs = "".join(sorted(set(c for c in text if not c.isalnum())))
    out = ["bias", f"shape={shape}", f"signs={signs}", f"groups={len(groups)}", f"n={min(sum(groups), 40)}", f"sizes={','.join(map(str, groups[:6]))}"]
    out += [f"first={_kind(text[0])}", f"letters={any(c.isalpha() for c in text)}"]
    if "@" in text:
        out.append(f"mail={bool(re.fullmatch(r'[^@ ]+@[^@ ]+[.][^@ ]+', text))}")
    if text[0].isalpha():
        out.append(f"iban={bool(re.fullmatch(r'[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}', text))}")
    return out


def checked(text: str) -> tuple[bool, bool]:
    """Whether ``checks`` looks at the digits of such a segment: at their Luhn sum, as octets."""
    groups = re.findall("[0-9]+", text)
    luhn_ = 12 <= sum(map(len, groups)) <= 19 and not any(c.isalpha() for c in text)
    return luhn_, len(groups) == 4 and {c for c in text if not c.isalnum()} == {"."}


def checks(text: str, which: tuple[bool, bool]) -> list[str]:
    out = [f"luhn={luhn(_digits(text))}"] if which[0] else []
    if which[1]:
        out.append(f"octets={all(0 <= int(p) <= 255 for p in text.split('.') if len(p) < 5 and p.isascii() and p.isdigit())}")
    return out


class Sentence:
    """Tokens with their places, and the segments that may be entities."""

    def __init__(self, text: str):
        self.text = text
        self.places = places = [m.span() for m in _TOKEN.finditer(text)]
        self.tokens = [text[a:b] for a, b in places]
        kinds = [_kind(t) for t in self.tokens]
        #: by the token after a segment, its first tokens in order
        self.starts: dict[int, list[int]] = defaultdict(list)
        for i, k in enumerate(kinds):
            if k not in ("d", "a", "+", "("):
                continue
            told, room = False, MOST_DIGITS[k == "a"]
            for j in range(i, min(len(kinds), i + REACH)):
                if j > i and places[j][0] - places[j - 1][1] > 1:
                    break  # entities hold single blanks only
                if kinds[j] == "d" and (room := room - len(self.tokens[j])) < 0:
                    break
                told = told or kinds[j] in ("d", "@")
                if told and kinds[j] in ("d", "a"):
                    self.starts[j + 1].append(i)

    @cached_property
    def segments(self) -> dict[int, list[tuple[int, list[str]]]]:
        """The segments with all their features."""
        return {end: [(i, self.features(i, end - 1)) for i in starts] for end, starts in self.starts.items()}

    def features(self, i: int, j: int) -> list[str]:
        text = self.text[self.places[i][0] : self.places[j][1]]
        return [*own_features(text), *checks(text, checked(text)), *self.before(i), *self.after(j)]

    # what touches the segment tells whether it starts too late or ends too early

    def before(self, i: int) -> tuple[str, ...]:
        near = {t.lower() for t in self.tokens[max(0, i - 4) : i]}
        a = self.places[i][0]
        last = self.tokens[i - 1][-1] if i and a - self.places[i - 1][1] <= 1 else ""
        cues = [f"cue={k}" for k, words in _CUES.items() if near & words]
        return (*cues, f"left={_touching(self.text[max(0, a - 1) : a])}", f"previous={_touching(last)}")

    def after(self, j: int) -> tuple[str, ...]:
        b = self.places[j][1]
        first = self.tokens[j + 1][0] if j + 1 < len(self.tokens) and self.places[j + 1][0] - b <= 1 else ""
        return f"right={_touching(self.text[b : b + 1])}", f"next={_touching(first)}"


class Weights(dict[tuple[str, str], float]):
    """Weights by kind and feature, and what segments score by them in units of 0.0001."""

    @cached_property
    def by_feature(self) -> dict[str, tuple[int, ...]]:
        """A feature's weights for all kinds; fixed once it is asked for."""
        return {f: tuple(round(10_000 * self.get((k, f), 0.0)) for k in KINDS) for f in {f for _, f in self}}

    @cached_property
    def _kept(self) -> tuple[dict, dict]:
        return {}, {}

    def total(self, features: Iterable[str]) -> tuple[int, ...]:
        rows = [row for f in features if (row := self.by_feature.get(f))]
        return tuple(map(sum, zip(*rows, strict=True))) if rows else (0,) * len(KINDS)

    def best(self, text: str, classes: str, before: tuple[str, ...], after: tuple[str, ...]) -> tuple[int, str]:
        """The best kind's score, of equal ones the first; segments that look alike are scored once."""
        owns, scores = self._kept
        if classes not in owns:
            if len(owns) >= CACHED_SCORES:
                owns.clear()
            owns[classes] = self.total(own_features(classes)), checked(classes)
        own, which = owns[classes]
        more = tuple(checks(text, which)) if any(which) else ()
        if (key := (classes, more, before, after)) not in scores:
            if len(scores) >= CACHED_SCORES:
                scores.clear()
            sums = tuple(map(sum, zip(own, self.total((*more, *before, *after)), strict=True)))
            scores[key] = max(sums), KINDS[sums.index(max(sums))]
        return scores[key]


def _scores(sentence: Sentence, w: Weights) -> dict[int, list[tuple[int, str, float, list[str]]]]:
    get = w.get
    return {
        end: [(i, k, sum(get((k, f), 0.0) for f in features), features) for i, features in segments for k in KINDS]
        for end, segments in sentence.segments.items()
    }


def decode(sentence: Sentence, w: Weights) -> list[Span]:
    """The best segmentation: entities as spans of the sentence's text."""
    n, places, classes = len(sentence.tokens), sentence.places, sentence.text.translate(_CLASS)
    best, back = [0] * (n + 1), [None] * (n + 1)
    before = {i: sentence.before(i) for i in {i for starts in sentence.starts.values() for i in starts}}
    for j in range(1, n + 1):
        best[j] = best[j - 1]  # one token outside scores nothing
        if starts := sentence.starts.get(j):
            after, b = sentence.after(j - 1), places[j - 1][1]
            for i in starts:
                a = places[i][0]
                score, kind = w.best(sentence.text[a:b], classes[a:b], before[i], after)
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
    spans, j = [], n
    while j:
        if back[j]:
            i, kind = back[j]
            spans.append((sentence.places[i][0], sentence.places[j - 1][1], kind))
            j = i
        else:
            j -= 1
    return spans[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _gradient(sentence: Sentence, gold: set[Span], w: Weights) -> Counter:
    """Of the conditional log likelihood, by forward and backward sums over segmentations."""
    scored, n = _scores(sentence, w), len(sentence.tokens)
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = forward[j - 1]
        for i, _, score, _ in scored.get(j, ()):
            forward[j] = _log_add(forward[j], forward[i] + score)
    backward = [-math.inf] * (n + 1)
    backward[n] = 0.0
    for j in range(n, 0, -1):
        backward[j - 1] = backward[j] if backward[j - 1] == -math.inf else _log_add(backward[j - 1], backward[j])
        for i, _, score, _ in scored.get(j, ()):
            value = backward[j] + score
            backward[i] = value if backward[i] == -math.inf else _log_add(backward[i], value)
    out: Counter = Counter()
    for j, segments in scored.items():
        for i, kind, score, features in segments:
            p = math.exp(forward[i] + score + backward[j] - forward[n])
            sure = (sentence.places[i][0], sentence.places[j - 1][1], kind) in gold
            if abs(sure - p) > 1e-4:
                for f in features:
                    out[(kind, f)] += sure - p
    return out


def _entity(rng: random.Random, kind: str) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    if kind == "email":
        return f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([word(), d(2)])}@{word()}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = rng.choice("3456") + d(14)
        full = head + next(c for c in "0123456789" if luhn(head + c))
        return rng.choice([full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))])
    if kind == "phone":
        area, a, b = d(3), d(3), d(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"+{rng.randint(1, 99)} {area} {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}"])
    if kind == "ssn":
        return f"{d(3)}-{d(2)}-{d(4)}"
    body = d(rng.choice([14, 16, 18, 20]))
    head = "".join(rng.choice("ABCDEFGHIKLNPRST") for _ in range(2)) + d(2)
    return rng.choice([head + body, head + " " + " ".join(body[i : i + 4] for i in range(0, len(body), 4))])


def _harmless(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    bad = "4" + d(14)
    return rng.choice(
        [d(rng.randint(1, 9)), f"{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)},{d(3)}", f"${d(3)}", f"{d(2)}%",
         f"{d(3)}.{d(3)}.{d(3)}.999", bad + next(c for c in "0123456789" if not luhn(bad + c)), f"{d(3)}-{d(3)}", f"v{d(1)}.{d(1)}.{d(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)),
         f"{d(2)}/{d(2)}/{d(4)}", f"{d(10)}", f"{d(3)} {d(3)}", f"@{rng.choice(['home', 'user', 'team'])}", f"no. {d(2)}-{d(1)}"]
    )


def generated(n: int, seed: int) -> Iterator[tuple[str, set[Span]]]:
    rng = random.Random(seed)
    plain = "the of and to in for with said est une die von que los are was here about".split()
    for _ in range(n):
        text, gold = "", set()
        for _ in range(rng.randint(1, 3)):
            text += " ".join(rng.choices(plain, k=rng.randint(1, 3))) + " "
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if rng.random() < 0.5:
                    text += rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": ", " is "])
                item = _entity(rng, kind)
                gold.add((len(text), len(text) + len(item), kind))
                text += item
                if rng.random() < 0.3:  # entities in a row
                    kind = rng.choice(KINDS)
                    item = _entity(rng, kind)
                    gold.add((len(text) + 1, len(text) + 1 + len(item), kind))
                    text += " " + item
                text += rng.choice([" ", ". ", ", ", "### ", "*** ", "&&& "])
            else:
                text += _harmless(rng) + rng.choice([" ", ". ", ", "])
        yield text + rng.choice(plain), gold


@lru_cache(maxsize=2)
def trained(n: int = 500, epochs: int = 3, seed: int = 11) -> Weights:
    """Weights learned from ``n`` generated sentences; Adagrad steps, one a sentence."""
    w = Weights()
    squares: dict[tuple[str, str], float] = defaultdict(float)
    made = [(Sentence(text), gold) for text, gold in generated(n, seed)]
    for k in KINDS:
        w[(k, "bias")] = -2.0
    for _ in range(epochs):
        for sentence, gold in made:
            for key, g in _gradient(sentence, gold, w).items():
                squares[key] += g * g
                w[key] = w.get(key, 0.0) + 0.5 * g / math.sqrt(squares[key] + 1e-3)
    return Weights({key: round(v, 4) for key, v in w.items() if abs(v) > 1e-3})


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Ranges around digits and ``@``, joined where they meet."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if end >= 0 and m.start() <= end:
            end = max(end, m.start() + AFTER)
            continue
        if end >= 0:
            yield start, end
        start, end = max(0, m.start() - BEFORE), m.start() + AFTER
    if end >= 0:
        yield start, min(end, len(text))


def added_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """The field's entities that no base finding overlaps."""
    found = []
    for start, end in windows(text):
        # long windows go in parts that overlap, so that memory stays bounded
        for a in range(start, end, 1500):
            part = text[a : min(end, a + 1500 + BEFORE + AFTER)]
            found += [(a + x, a + y, k) for x, y, k in decode(Sentence(part), w)]
    out: list[Span] = []
    taken: list[tuple[int, int]] = []  # base findings, joined where they overlap
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    next_ = 0
    for s in sorted(set(found), key=lambda s: (s[0], -s[1], ORDER[s[2]])):
        while next_ < len(taken) and taken[next_][1] <= s[0]:
            next_ += 1
        if not (next_ < len(taken) and taken[next_][0] < s[1]) and not (out and s[0] < out[-1][1]):
            out.append(s)
    return out


def find_personal(text: str | None, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base findings and added ones."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, w)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each finding (joined where they overlap) replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]])):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
            end = b
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


FOUND = [
    *(T.StructField(c, T.StringType()) for c in ("base", "spans")),
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("redacted", T.StringType()),
]


def _find(shared, redact: bool):
    names = ["_id", "base", "spans", *(f"n_{k}" for k in KINDS), "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            base_text, all_text, counts, clean = [], [], [], []
            for t in batch.column(1):
                t = t.as_py()
                base, added = find_personal(t, w)
                base_text.append(joined(base))
                all_text.append(joined(base + added))
                own, more = Counter(k for *_, k in base), Counter(k for *_, k in added if k in ADDED)
                counts.append([own[k] for k in BASE] + [more[k] for k in ADDED])
                clean.append(redacted(t, base + added) if redact else None)
            columns = [[c[i] for c in counts] for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), *(pa.array(c, pa.int64()) for c in columns), pa.array(clean, pa.string())],
                names,
            )

    return tidy(run)


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """id, ``base`` and ``spans`` (kind:start:end, joined), counts by kind, and the redacted text if asked for."""
    lean_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *FOUND])
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_find(shared, redact), schema)
    return found.withColumnRenamed("_id", id_col)


def op3_pii(docs: DataFrame) -> DataFrame:
    return scan_personal(docs).select(
        "doc_id",
        *(f"n_{k}" for k in BASE),
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        *(f"n_{k}" for k in ADDED),
        sum((F.col(f"n_{k}") for k in (*BASE, *ADDED)), F.lit(0).cast("bigint")).alias("n_spans"),
    )


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
