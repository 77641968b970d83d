"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate regions.

The field scores whole spans (their shape, size, signs and surroundings), and a dynamic program over
segments of bounded length chooses boundaries and kinds together. It is trained on what the patterns
find in a bounded sample, rewritten in other usual forms, so that it also finds forms the patterns
miss. Its spans come on top of those of the patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts, written

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# Each pattern consumes a run at once, so that none is tried again from within a long run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each @ with a domain back over the local part, not into the match before."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()
        else:  # the @ has no local part; a later one may use what follows
            free = max(free, m.start() + 1)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping within a kind; failing ones are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, e, "email") for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# --- the semi-Markov field -------------------------------------------------------------------------

#: Most tokens and characters of a segment, and how far from a digit or @ a region reaches.
MOST_TOKENS, MOST_CHARS, REACH = 16, 64, 32
_ANCHOR = re.compile(r"[0-9]+|@")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @ in which segments may lie; everywhere else the field says none."""
    start = end = None
    for m in _ANCHOR.finditer(text):
        if start is not None and m.start() - REACH <= end:
            end = m.end() + REACH
        else:
            if start is not None:
                yield start, min(len(text), end)
            start, end = max(0, m.start() - REACH), m.end() + REACH
    if start is not None:
        yield start, min(len(text), end)


def shape(text: str) -> str:
    """Letters as a, digit runs as their length (9 stands for 9 and more), white space as one blank."""
    text = re.sub(r"[^\W\d_]+", "a", text)
    text = re.sub(r"[0-9]+", lambda m: f"<{min(9, len(m[0]))}>", text)
    return re.sub(r"\s+", " ", text)


_WORD_BEFORE = re.compile(r"([^\W\d_]{2,12})[\W_]{0,3}$")


def word_before(text: str, at: int) -> str:
    """The word that leads to a span, in lower case."""
    m = _WORD_BEFORE.search(text, max(0, at - 16), at)
    return m[1].lower() if m else ""


def near(text: str, at: int, step: int) -> str:
    """Sort of the character at a boundary of a span."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "blank" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


def span_features(text: str, s: int, e: int) -> list[str]:
    """What is known of a candidate as a whole and of its two sides, for any kind."""
    span = text[s:e]
    form = shape(span)
    loose = re.sub(r"<\d>", "0", form)
    digits = sum(c.isdigit() for c in span)
    loose = re.sub(r"(?:a|0)(?:[._%+-]*(?:a|0))*", "w", loose) if "@" in span else loose
    out = ["bias", f"at {'@' in span}", f"shape {form if '@' not in span else loose}", f"loose {loose}", f"digits {digits if digits < 20 else 20}", f"before {near(text, s - 1, -1)}", f"word {word_before(text, s)}", f"after {near(text, e, 1)}", f"signs {''.join(sorted(set(re.sub(r'[\w\s]', '', span))))}"]
    if 12 <= digits <= 19 and span.isascii():
        plain = re.sub(r"[^0-9]", "", span)
        # what a card number has: a check digit, and an issuer by its first digit and length
        out += [f"check digit {luhn(plain)}", f"issuer {plain[0]} {len(plain)} {luhn(plain)}"]
    parts = span.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("bytes" if all(len(p) < 4 and int(p) < 256 for p in parts) else "not bytes")
    return out


@dataclass
class Lattice:
    """A region's tokens and candidate segments: (first token, token after the last, features)."""
    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int, list[str]]]


def lattice(text: str, start: int, end: int) -> Lattice:
    """Candidates start and end at tokens that are not blank, have at least four digits or an @, and are bounded in
    length; the program is linear in the region's length."""
    toks = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]
    digits = np.cumsum([0] + [e - s if text[s].isdigit() else 0 for s, e in toks])
    ats = np.cumsum([0] + [text[s] == "@" for s, e in toks])
    solid = [not text[s].isspace() for s, _ in toks]
    opens = [text[s].isalnum() or text[s] in "+([" for s, _ in toks]
    closes = [text[s].isalnum() or text[s] in ")]" for s, _ in toks]
    out = []
    for i in range(len(toks)):
        if not (solid[i] and opens[i]):
            continue
        for j in range(i + 1, min(len(toks), i + MOST_TOKENS) + 1):
            if toks[j - 1][1] - toks[i][0] > MOST_CHARS:
                break
            at = ats[j] - ats[i]
            if closes[j - 1] and at <= 1 and (digits[j] - digits[i] >= 4 or at) and not (not at and any(text[s].isalpha() for s, _ in toks[i:j])):
                out.append((i, j, span_features(text, toks[i][0], toks[j - 1][1])))
    return Lattice(toks, out)


@dataclass
class Field:
    """Weights by feature (rows) and kind (columns)."""
    names: dict[str, int]
    weights: np.ndarray

    def scores(self, lat: Lattice) -> np.ndarray:
        """Score of each candidate as each kind; a token outside of entities scores 0."""
        out = np.zeros((len(lat.segments), len(KINDS)))
        for k, (_, _, fs) in enumerate(lat.segments):
            for f in fs:
                if (i := self.names.get(f)) is not None:
                    out[k] += self.weights[i]
        return out


def best_segments(lat: Lattice, scores: np.ndarray) -> list[Span]:
    """The segmentation of the highest total score; boundaries and kinds are chosen together."""
    n = len(lat.tokens)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(lat.segments):
        by_end.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            total = best[lat.segments[k][0]] + scores[k].max()
            if total > best[j]:
                best[j], back[j] = total, k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            i, _, _ = lat.segments[back[j]]
            out.append((lat.tokens[i][0], lat.tokens[j - 1][1], KINDS[int(scores[back[j]].argmax())]))
            j = i
    return out[::-1]


def expected(lat: Lattice, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and each candidate's probability by kind (forward, backward)."""
    n = len(lat.tokens)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(lat.segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for k in by_end.get(j, ()):
            ahead[j] = np.logaddexp(ahead[j], ahead[lat.segments[k][0]] + whole[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in by_start.get(i, ()):
            behind[i] = np.logaddexp(behind[i], whole[k] + behind[lat.segments[k][1]])
    shares = np.array([ahead[i] + behind[j] - ahead[n] for i, j, _ in lat.segments])
    return ahead[n], np.exp(shares[:, None] + scores) if len(scores) else np.zeros((0, len(KINDS)))


def other_forms(kind: str, span: str) -> list[str]:
    """Usual ways to write the same thing that the patterns do not match."""
    if kind == "phone":
        tail = re.sub(r"^\+\d+[ .-]*", "", span)
        digits = re.sub(r"\D", "", tail)
        ten = digits[-10:]
        return [tail, f"{ten[:3]}-{ten[3:6]}-{ten[6:]}", f"{ten[:3]}.{ten[3:6]}.{ten[6:]}"] if len(ten) == 10 else [tail]
    if kind == "card":
        digits = re.sub(r"\D", "", span)
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    if kind == "email":
        return [span.replace("@", " @ ")]
    return []


def plain_numbers(span: str) -> list[str]:
    """What numbers stand for besides persons, made from the digits of a span: date and time, version, amount, and a
    run of as many digits without a check digit."""
    d = re.sub(r"[^0-9]", "", span)
    if len(d) < 8:
        return []
    a, b, c = int(d[:2]), int(d[2:4]), int(d[4:6])
    run = next((x for x in (d[:-1] + str(k) for k in range(10)) if not luhn(x)), d)
    return [f"{1980 + a % 60}-{1 + b % 12:02d}-{1 + c % 28:02d} {b % 24:02d}:{c % 60:02d}:{a % 60:02d}", f"v{a}.{b}.{c}{d[6:8]}", f"{a},{d[2:5]}.{d[5:7]}", f"{1 + c % 28:02d}/{1 + b % 12:02d}/{1980 + a % 60}", run]


def examples(text: str) -> list[tuple[str, list[Span]]]:
    """Regions of a text with the spans found there, and copies with each span in another form or with a plain
    number, which is no span, in its place."""
    spans, out = base_spans(text), []
    for start, end in regions(text):
        inside = [s for s in spans if start <= s[0] and s[1] <= end]
        window = text[start:end]
        out.append((window, [(s - start, e - start, k) for s, e, k in inside]))
        for s, e, k in inside:
            if sum(not (y <= s or x >= e) for x, y, _ in inside) > 1:
                continue
            for form, kind in [*((f, k) for f in other_forms(k, text[s:e])), *((f, None) for f in plain_numbers(text[s:e]))]:
                moved = [(a - start + (len(form) - (e - s) if a >= e else 0), b - start + (len(form) - (e - s) if a >= e else 0), c) for a, b, c in inside if (a, b, c) != (s, e, k)]
                out.append((text[start:s] + form + text[e:end], sorted([*moved, *([(s - start, s - start + len(form), k)] if kind else [])])))
    return out


def train(sample: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps, one region at a time in a fixed random order."""
    names: dict[str, int] = {}
    cases = []
    for text, spans in sample:
        lat = lattice(text, 0, len(text))
        if not lat.segments or len(lat.tokens) > 400:
            continue
        ids = [[names.setdefault(f, len(names)) for f in fs] for _, _, fs in lat.segments]
        want = np.zeros((len(ids), len(KINDS)))
        place = {(lat.tokens[i][0], lat.tokens[j - 1][1]): k for k, (i, j, _) in enumerate(lat.segments)}
        for s, e, kind in spans:
            if (s, e) in place:
                want[place[s, e], KINDS.index(kind)] = 1
        cases.append((lat, ids, want))
    field = Field(names, np.zeros((len(names), len(KINDS))))
    squares = np.ones_like(field.weights)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for c in order.permutation(len(cases)):
            lat, ids, want = cases[c]
            scores = np.array([field.weights[i].sum(0) for i in ids])
            _, share = expected(lat, scores)
            for i, g in zip(ids, share - want):
                step = g + l2 * field.weights[i]
                squares[i] += step ** 2
                field.weights[i] -= rate * step / np.sqrt(squares[i])
    return field


def fit(docs: DataFrame, most_regions: int = 1500, most_rows: int = 4000, epochs: int = 6) -> Field:
    """The field, fitted on at most ``most_regions`` regions of at most ``most_rows`` rows with digits or @.

    The rows are those least by a hash of their id among a cut of about ``most_rows``; what patterns find in
    them are the labels. Without any such row the field is empty and finds nothing."""
    some = texts(docs).filter(F.col("text").rlike("[0-9@]"))
    total = some.count()
    cut = int(min(1.0, most_rows / max(1, total)) * (1 << 30))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, w, listed(s)) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for w, s in examples(t) if len(w) <= 2000]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "window", "spans"])

    rows = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut).mapInArrow(pick, "doc_id long, window string, spans string")
    rows = written(rows.select("window", "spans").distinct(), "regions")
    # regions with spans and without, least by hash
    parts = [rows.filter(cond).orderBy(F.xxhash64("window"), "window", "spans").limit(n) for cond, n in
             (("spans <> ''", most_regions - most_regions // 3), ("spans = ''", most_regions // 3))]
    rows = parts[0].union(parts[1]).collect()
    sample = []
    for r in rows:
        spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        sample.append((r["window"], spans))
    return train(sample, epochs)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those of the field that overlap none of them."""
    base = base_spans(text)
    more: list[Span] = []
    if field.names:
        taken = sorted((s, e) for s, e, _ in base)
        for start, end in regions(text):
            lat = lattice(text, start, end)
            if lat.segments:
                more += [x for x in best_segments(lat, field.scores(lat)) if not any(s < x[1] and x[0] < e for s, e in taken)]
    return base, more


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of the patterns' spans ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``, ``base`` and ``spans`` (all, the field's on top) as ``kind:start:end``, comma-joined, by start
    and then kind, in code points, end exclusive, and ``n_more`` of the field.

    Whole texts are searched; a null text is empty. Rows without digits or @ have no spans."""
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_more")}
            for t in b.column("text"):
                text = t.as_py()
                base, more = all_spans(text, own) if _ANCHOR.search(text) else ([], [])
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for *_, k in base))
                out["base"].append(listed(base))
                out["spans"].append(listed(base + more))
                out["n_more"].append(len(more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, pa.string() if k in ("base", "spans") else pa.int64()) for k, v in out.items()]], ["doc_id", *out])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_more long")
