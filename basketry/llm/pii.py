"""Personal data: patterns, and a semi-Markov conditional random field for other forms.

Base spans are what fixed patterns match (see ``base_spans``); they always stay. The
semi-Markov field looks at windows of text around digits and at-signs (also written
out). Every stretch of at most ``MAX_TOKENS`` tokens that could be an entity is a
candidate segment, scored as a whole: how many digits in which groups, checksum,
number ranges, separators, a domain's end, what stands before and after. Together
with scores of plain tokens and of neighbouring types, dynamic programming over
entities of bounded length finds the best segmentation, boundaries and types at once.
What it finds beside base spans is added.

The field is trained by maximum likelihood on a bounded sample of all windows. Their base
spans are the truth; copies with spans rewritten in other common forms (written-out
at and dot, numbers without a plus or with other separators) are truth as well, so it
learns the forms from whole-span features rather than from the patterns alone.

Null and empty texts hold nothing. Repeated rows get equal spans. With an empty table,
or none of a type in the sample, nothing of that type is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import forget, keep

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 14, 80

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # from within digits it fails just the same
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANCHOR = re.compile(
    r"@|[0-9][0-9().\x20-]{5,}[0-9]|[\[(]at[\])]|\bat [A-Za-z0-9-]+ (?:dot|\.)", re.IGNORECASE
)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]|[^\S\x20]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20-]*[0-9]")
_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]|\bat\b) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
#: Words that announce a type.
CUES = {
    "email": frozenset("mail email e contact write".split()),
    "ip": frozenset("ip host server address addr".split()),
    "card": frozenset("card visa credit debit mastercard payment".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax dial".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and kind; time linear in the text."""
    spans = []
    at, after = text.find("@"), 0
    while at >= 0:
        # The match that ends in this at-sign starts with the run of characters before it.
        start = after + len(text[after:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at) if start < at else None
        after = at + 1
        if domain:
            after = domain.end()
            spans.append((start, after, "email"))
        at = text.find("@", after)
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.group().split(".")):
            spans.append((*found.span(), "ip"))
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((*found.span(), "card"))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_digits(found.group())) <= 15:
                spans.append((*found.span(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(text: str, reach: int = 48) -> list[tuple[int, int]]:
    """Stretches around anchors, cut at white space where there is some."""
    found: list[tuple[int, int]] = []
    for anchor in _ANCHOR.finditer(text):
        start = text.find(" ", max(0, anchor.start() - reach), anchor.start()) + 1 or max(0, anchor.start() - reach)
        end = text.rfind(" ", anchor.end(), anchor.end() + reach)
        end = end if end >= 0 else min(len(text), anchor.end() + reach)
        if anchor.start() <= reach:
            start = 0
        if anchor.end() + reach >= len(text):
            end = len(text)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


#: Whole-span features by name; each has a weight per type.
FEATURES = (
    "any digits<7 digits7-8 digits9-11 digits12-15 digits16 digits17+ plus bracket luhn octets dots3 "
    "groups1 groups2 groups3 groups4 groups5+ group334 group4444 space dash dot mail at-sign at-word "
    "letters-end known-end glued-before glued-after cue-email cue-ip cue-card cue-phone no-cue"
).split()
_FEATURE = {name: i for i, name in enumerate(FEATURES)}
_PLAIN = ("digits", "letters", "other")
_ENDS = frozenset("com org net edu gov io de fr es uk info".split())


@dataclass
class Lattice:
    """Tokens of a window, its candidate segments and their features."""

    tokens: list[tuple[int, int]]
    plain: list[int]
    segments: list[tuple[int, int]]  # first token, token after the last
    features: list[list[int]]


def _features(text: str, start: int, end: int, before: list[str]) -> list[int]:
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    count = len(digits)
    named = ["any"]
    is_mail = _MAIL.fullmatch(span) is not None
    if is_mail:
        named += ["mail", "at-sign" if "@" in span else "at-word"]
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        named += ["letters-end"] * last.isalpha() + ["known-end"] * (last.lower() in _ENDS)
    else:
        limits = ((6, "digits<7"), (8, "digits7-8"), (11, "digits9-11"), (15, "digits12-15"), (16, "digits16"))
        named.append(next((name for most, name in limits if count <= most), "digits17+"))
        named.append(f"groups{len(groups)}" if len(groups) < 5 else "groups5+")
        named += ["plus"] * span.startswith("+") + ["bracket"] * ("(" in span)
        named += ["luhn"] * (12 <= count <= 19 and luhn(digits))
        parts = span.split(".")
        numeric = len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts)
        octets = numeric and all(int(p) < 256 for p in parts)
        named += ["octets"] * octets + ["dots3"] * (span.count(".") == 3 and not octets)
        named += ["group334"] * (groups[-3:] == [3, 3, 4]) + ["group4444"] * (groups == [4, 4, 4, 4])
        named += ["space"] * (" " in span) + ["dash"] * ("-" in span) + ["dot"] * ("." in span)
    named += ["glued-before"] * (start > 0 and not text[start - 1].isspace() and text[start - 1] not in "([:;,\"'|")
    named += ["glued-after"] * (end < len(text) and not text[end].isspace() and text[end] not in ")].:;,!?\"'|")
    cues = [f"cue-{kind}" for kind in KINDS if CUES[kind] & set(before)]
    named += cues or ["no-cue"]
    return [_FEATURE[n] for n in named]


def lattice(text: str, start: int, end: int) -> Lattice:
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    plain = [0 if "0" <= text[a] <= "9" else 1 if text[a].isalpha() else 2 for a, _ in tokens]
    words = [text[a:b].lower() for a, b in tokens]
    mail = _ANCHOR_AT.search(text, start, end) is not None
    segments, features = [], []
    for i, (first, _) in enumerate(tokens):
        if plain[i] == 2 and text[first] not in "+(._%-":
            continue
        digits = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            last = tokens[j][1]
            if last - first > MAX_CHARS:
                break
            digits += last - tokens[j][0] if plain[j] == 0 else 0
            if plain[j] == 2:
                continue
            span = text[first:last]
            if plain[j] == 0 and digits >= 4 and _NUMBER.fullmatch(span) or mail and j - i >= 4 and _MAIL.fullmatch(span):
                segments.append((i, j + 1))
                features.append(_features(text, first, last, words[max(0, i - 3) : i]))
    return Lattice(tokens, plain, segments, features)


_ANCHOR_AT = re.compile(r"@|[\[(]at[\])]|\bat\b", re.IGNORECASE)


@dataclass(frozen=True)
class Model:
    """Weights: (type, feature), (plain token class), (type before, type); type 0 is plain."""

    span: np.ndarray
    plain: np.ndarray
    move: np.ndarray

    def segment_scores(self, at: Lattice) -> np.ndarray:
        """(segment, type from 1)."""
        return np.array([self.span[:, f].sum(1) for f in at.features]).reshape(-1, len(KINDS))

    def best(self, at: Lattice) -> list[tuple[int, int, str]]:
        """Entities of the best segmentation, as (first token, token after the last, kind)."""
        scores, types = self.segment_scores(at), 1 + len(KINDS)
        ending: dict[int, list[int]] = {}
        for number, (_, end) in enumerate(at.segments):
            ending.setdefault(end, []).append(number)
        best = np.full((len(at.tokens) + 1, types), -np.inf)
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        best[0, 0] = 0.0
        for end in range(1, len(at.tokens) + 1):
            came = best[end - 1] + self.move[:, 0]
            best[end, 0] = came.max() + self.plain[at.plain[end - 1]]
            back[end, 0] = (end - 1, int(came.argmax()), -1)
            for number in ending.get(end, ()):
                first = at.segments[number][0]
                came = best[first][:, None] + self.move[:, 1:]
                top = came.max(0) + scores[number]
                for kind in np.flatnonzero(top > best[end, 1:]):
                    best[end, kind + 1] = top[kind]
                    back[end, int(kind) + 1] = (first, int(came[:, kind].argmax()), number)
        found, end, kind = [], len(at.tokens), int(best[-1].argmax())
        while end:
            first, before, _ = back[end, kind]
            if kind:
                found.append((first, end, KINDS[kind - 1]))
            end, kind = first, before
        return found[::-1]


def _gradient(model: Model, at: Lattice, gold: dict[tuple[int, int], int]) -> tuple[float, Model] | None:
    """Log likelihood of the true segmentation and its gradient; None if it is no path."""
    if not set(gold) <= set(at.segments):
        return None
    scores, types, count = model.segment_scores(at), 1 + len(KINDS), len(at.tokens)
    starting: dict[int, list[int]] = {}
    ending: dict[int, list[int]] = {}
    for number, (first, end) in enumerate(at.segments):
        starting.setdefault(first, []).append(number)
        ending.setdefault(end, []).append(number)
    forward = np.full((count + 1, types), -np.inf)
    forward[0, 0] = 0.0
    add = np.logaddexp
    for end in range(1, count + 1):
        forward[end, 0] = add.reduce(forward[end - 1] + model.move[:, 0]) + model.plain[at.plain[end - 1]]
        for number in ending.get(end, ()):
            came = add.reduce(forward[at.segments[number][0]][:, None] + model.move[:, 1:], axis=0)
            forward[end, 1:] = add(forward[end, 1:], came + scores[number])
    backward = np.full((count + 1, types), -np.inf)
    backward[count] = 0.0
    for first in range(count - 1, -1, -1):
        ways = [model.move[:, 0] + model.plain[at.plain[first]] + backward[first + 1, 0]]
        for number in starting.get(first, ()):
            onward = scores[number] + backward[at.segments[number][1], 1:]
            ways.append(add.reduce(model.move[:, 1:] + onward, axis=1))
        backward[first] = add.reduce(ways, axis=0)
    total = add.reduce(forward[count])
    span, plain, move = np.zeros_like(model.span), np.zeros_like(model.plain), np.zeros_like(model.move)
    for first in range(count):
        own = forward[first] + model.move[:, 0] + model.plain[at.plain[first]] + backward[first + 1, 0] - total
        chance = np.exp(own)
        plain[at.plain[first]] -= chance.sum()
        move[:, 0] -= chance
    for number, (first, end) in enumerate(at.segments):
        chance = np.exp(
            forward[first][:, None] + model.move[:, 1:] + scores[number] + backward[end, 1:] - total
        )
        move[:, 1:] -= chance
        for feature in at.features[number]:
            span[:, feature] -= chance.sum(0)
    likelihood, before, place = -total, 0, 0
    numbers = {segment: number for number, segment in enumerate(at.segments)}
    starts = {first: (first, end) for first, end in gold}
    while place < count:
        if place in starts:
            segment = starts[place]
            kind, number = gold[segment], numbers[segment]
            likelihood += scores[number, kind - 1] + model.move[before, kind]
            for feature in at.features[number]:
                span[kind - 1, feature] += 1
            place = segment[1]
        else:
            kind = 0
            likelihood += model.plain[at.plain[place]] + model.move[before, 0]
            plain[at.plain[place]] += 1
            place += 1
        move[before, kind] += 1
        before = kind
    return float(likelihood), Model(span, plain, move)


def rewritten(text: str, spans: list[tuple[int, int, str]], form: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its spans in another form, and where they are now."""
    parts, found, at, length = [], [], 0, 0
    for start, end, kind in spans:
        span = text[start:end]
        if kind == "email":
            marks = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))[form % 3]
            local, _, domain = span.partition("@")
            span = local + marks[0] + domain.replace(".", marks[1])
        elif kind == "phone":
            groups = re.findall(r"[0-9]+", span)[-3:]
            groups = groups if len(groups) == 3 else [span.lstrip("+")]
            span = ("{}-{}-{}", "({}) {}-{}", "{}.{}.{}")[form % 3].format(*groups) if len(groups) == 3 else groups[0]
        elif kind == "card" and span.isdigit() and len(span) == 16:
            mark = (" ", "-", ".")[form % 3]
            span = mark.join(span[i : i + 4] for i in range(0, 16, 4))
        parts += [text[at:start], span]
        length += start - at
        found.append((length, length + len(span), kind))
        length += len(span)
        at = end
    return "".join(parts) + text[at:], found


def _example(text: str, spans: list[tuple[int, int, str]]) -> tuple[Lattice, dict[tuple[int, int], int]] | None:
    at = lattice(text, 0, len(text))
    first = {a: i for i, (a, _) in enumerate(at.tokens)}
    last = {b: i + 1 for i, (_, b) in enumerate(at.tokens)}
    gold, end = {}, 0
    for start, stop, kind in spans:
        if start < end:
            continue  # one segment for a place: the first span
        if start not in first or stop not in last:
            return None
        gold[first[start], last[stop]] = 1 + KINDS.index(kind)
        end = stop
    return at, gold


def train(texts: list[str], passes: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Maximum likelihood over windows and their rewritten copies, by adaptive gradient steps."""
    examples = []
    for number, text in enumerate(sorted(texts)):
        spans = base_spans(text)
        examples.append(_example(text, spans))
        if spans:
            other, moved = rewritten(text, spans, number)
            examples.append(_example(other, moved))
    examples = [e for e in examples if e and e[0].segments]
    types = 1 + len(KINDS)
    model = Model(np.zeros((len(KINDS), len(FEATURES))), np.zeros(len(_PLAIN)), np.zeros((types, types)))
    model.span[:, _FEATURE["any"]] = -2.0
    weights = (model.span, model.plain, model.move)
    squares = [np.full_like(w, 1e-2) for w in weights]
    order = np.random.default_rng(1)
    for _ in range(passes):
        for number in order.permutation(len(examples)):
            found = _gradient(model, *examples[number])
            if found is None:
                continue
            step = found[1]
            for weight, square, change in zip(weights, squares, (step.span, step.plain, step.move)):
                change = change - decay * weight
                square += change**2
                weight += rate * change / np.sqrt(square)
    return model


def _least_windows(
    batches: Iterator[pa.RecordBatch], most: dict[str, int], longest: int = 400
) -> Iterator[pa.RecordBatch]:
    """Of each type the windows of a task with the least hashes, at most ``most`` of them."""
    held: dict[str, dict[str, int]] = {kind: {} for kind in most}
    bound = dict.fromkeys(most, 2**63)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            for start, end in windows(text):
                window = text[start:end]
                if len(window) > longest:
                    continue
                mark = xxhash.xxh3_64_intdigest(window) - 2**63
                if mark >= max(bound.values()):
                    continue
                kind = min({k for _, _, k in base_spans(window)}, key=KINDS.index, default="none")
                if mark < bound[kind]:
                    held[kind][window] = mark
                    if len(held[kind]) >= 2 * most[kind]:
                        held[kind] = dict(sorted(held[kind].items(), key=lambda w: w[::-1])[: most[kind]])
                        bound[kind] = max(held[kind].values()) + 1
    rows = [
        (kind, *pair)
        for kind, own in held.items()
        for pair in sorted(own.items(), key=lambda w: w[::-1])[: most[kind]]
    ]
    kinds, texts, marks = zip(*rows) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(marks, pa.int64())],
        names=["kind", "window", "mark"],
    )


def learn(docs: DataFrame, id_column: str, text_column: str, max_windows: int = 60) -> Model:
    """Train on windows of all documents, a bounded number of them chosen by hash.

    At most ``max_windows`` different windows of each type, and twice as many without base
    spans; so a type that stands in few documents is learned as well. One pass over the
    documents, each task keeps as many windows.
    """
    most = {kind: max_windows for kind in KINDS} | {"none": 2 * max_windows}

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _least_windows(batches, most)

    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(text_column).alias("text"))
    found = keep(texts.mapInArrow(least, "kind string, window string, mark long"), "windows")
    sample: list[str] = []
    for kind, count in most.items():
        rows = found.where(F.col("kind") == kind).distinct().orderBy("mark", "window").limit(count)
        sample += [r["window"] for r in rows.collect()]
    forget(found)
    return train(sample)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: what the field finds beside them is added."""
    base = base_spans(text)
    # Base spans by start, and how far the spans up to each of them reach.
    ordered = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    added = []
    for start, end in windows(text):
        at = lattice(text, start, end)
        if not at.segments:
            continue
        for first, last, kind in model.best(at):
            place = at.tokens[first][0], at.tokens[last - 1][1]
            before = bisect_left(starts, place[1])
            if not before or reach[before - 1] <= place[0]:
                added.append((*place, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find(text: Column, model: Model) -> Column:
    """struct<base, spans>: arrays of struct<start, end, kind>, in code points, end exclusive."""
    span = "array<struct<start: int, end: int, kind: string>>"

    @F.arrow_udf(f"struct<base: {span}, spans: {span}>")
    def found(texts: pa.Array) -> pa.Array:
        base, spans = [], []
        for text in texts.to_pylist():
            own = all_spans(text, model) if text else ([], [])
            for out, rows in zip((base, spans), own):
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in rows])
        return pa.StructArray.from_arrays(
            [pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=["base", "spans"]
        )

    return found(text)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<KIND>``; overlapping spans become one."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), rows.to_pylist()):
            if not text or not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for span in spans:
                if span["start"] >= at:
                    parts += [text[at : span["start"]], f"<{span['kind'].upper()}>"]
                at = max(at, span["end"])
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return masked(text, spans)
