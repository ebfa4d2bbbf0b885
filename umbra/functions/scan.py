"""What a task does with one text: matches of the rules with their places, and what is left of overlapping spans."""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa

from umbra.functions import patterns, text

_NARROW = dict(zip(text.FULL, text.HALF, strict=True))
_WIDE = frozenset(_NARROW)


class Span(NamedTuple):
    """A stretch of a text, by code points."""

    start: int
    end: int
    label: str
    confidence: float
    source: str
    rule_id: str | None = None
    risk_level: str | None = None
    canonical_value: str | None = None
    clipped: bool = False


TYPES = {"start": "int", "end": "int", "label": "string", "confidence": "double", "source": "string", "rule_id": "string", "risk_level": "string", "canonical_value": "string", "clipped": "boolean"}


def ddl(types: dict[str, str]) -> str:
    return "array<struct<" + ", ".join(f"{n}:{t}" for n, t in types.items()) + ">>"


SPANS = ddl(TYPES)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows and bytes (a longer row is a part): what Python makes of them at a time grows neither with Spark's batches nor with texts."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > size:
            n //= 2
        yield batch.slice(at, n)
        at += n


def plain(values: pa.Array) -> list:
    """As to_pylist, in a tenth of the time for strings and for numbers without nulls."""
    kind, whole = values.type, not values.null_count
    easy = pa.types.is_string(kind) or pa.types.is_large_string(kind) or (whole and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)))
    return values.to_numpy(zero_copy_only=False).tolist() if easy else values.to_pylist()


def lists(structs: pa.ListArray) -> list[list[tuple] | None]:
    """An Arrow column of lists of structs as lists of tuples, field by field; null is None."""
    inner, ends, valid = structs.values, structs.offsets.to_pylist(), structs.is_valid().to_pylist()
    first, last = ends[0], ends[-1]
    inner = inner.slice(first, last - first)
    flat = list(zip(*(plain(inner.field(i).slice(0, last - first)) for i in range(inner.type.num_fields)), strict=True))
    return [flat[a - first : b - first] if ok else None for a, b, ok in zip(ends, ends[1:], valid)]  # noqa: B905, RUF007


def column(rows: list[list[tuple] | None], types: dict[str, str] = TYPES) -> pa.Array:
    """Lists of tuples as an Arrow column of lists of structs; None is null."""
    flat = [x for r in rows for x in r or ()]
    fields = [pa.array(values, _ARROW[t]) for values, t in zip(zip(*flat, strict=True) if flat else [[] for _ in types], types.values(), strict=True)]
    at, ends = 0, []
    for r in rows:
        ends.append(at if r is not None else None)
        at += len(r or ())
    return pa.ListArray.from_arrays(pa.array([*ends, at], pa.int32()), pa.StructArray.from_arrays(fields, list(types)))


def half_width(whole: str) -> str:
    if not whole.isascii():
        # A text holds few different characters of this kind, and many that aren't.
        for wide in _WIDE.intersection(whole):
            whole = whole.replace(wide, _NARROW[wide])
    return whole


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def private_keys(whole: str, view: str) -> tuple[list[tuple[int, int]], str | None]:
    """Bounds of whole PEM private keys, or what is wrong with their framing: then nothing of the text may be given out."""
    found, opened = [], None
    for m in _compiled(patterns.PRIVATE_KEY_MARKER).finditer(view):
        words = re.fullmatch(r"(?is)(-+)(begin|end)[ \t]+([^-]*)(-*)", m[0])
        name = " ".join(words[3].upper().split())
        if not (words[1] == words[4] == "-" * 5 and name.endswith("PRIVATE KEY")):
            return [], "incomplete private key block"
        if words[2].upper() == "BEGIN":
            if opened:
                return [], "nested private key block"
            opened = m.start(), m.end(), name
            continue
        if not opened or opened[2] != name:
            return [], "mismatched private key block"
        if not whole[opened[1] : m.start()].strip():
            return [], "empty private key block"
        found.append((opened[0], m.end()))
        opened = None
    return ([], "incomplete private key block") if opened else (found, None)


class Prepared(list):
    """Rules as a task runs them: (finditer or None for private keys, anchors, group, label, confidence, rule, risk)."""


def prepare(wanted: Iterable[patterns.Rule]) -> Prepared:
    out = Prepared()
    for r in wanted:
        key = r == patterns.PRIVATE_KEY
        out.append((None if key else _compiled(r.pattern).finditer, ("--",) if key else r.anchors, r.group, r.label, r.confidence, r.rule_id, r.risk))
    return out


def rules(whole: str, wanted: Iterable[patterns.Rule]) -> tuple[list[Span], str | None]:
    """Spans of all rules over the half-width view, in order. Of spans with equal bounds and label the most confident stays, then the rule last by name."""
    view, best = half_width(whole), {}
    for find, anchors, group, label, confidence, rule_id, risk in wanted if isinstance(wanted, Prepared) else prepare(wanted):
        for a in anchors:
            if a in view:
                break
        else:
            if anchors:
                continue
        if find is None:
            places, error = private_keys(whole, view)
            if error:
                return [], error
        else:
            places = [m.span(group) for m in find(view)]
        for start, end in places:
            key = start, end, label
            old = best.get(key)
            if old is None or (old.confidence, old.rule_id) < (confidence, rule_id):
                best[key] = Span(start, end, label, confidence, "rule", rule_id, risk)
    return [best[key] for key in sorted(best)], None


def priority(s: Span) -> int:
    if s.rule_id == patterns.PRIVATE_KEY.rule_id:
        return patterns.PRIVATE_KEY_PRIORITY
    return patterns.SOURCES.get(s.source, patterns.OTHER_SOURCE) + (patterns.SURE_RULE_BONUS if s.source == "rule" and s.confidence >= patterns.SURE_RULE else 0)


def rank(s: Span) -> tuple:
    """The order in which spans take characters."""
    return -priority(s), -s.confidence, s.start - s.end, s.start, s.end, s.label, s.source


def sweep(bounds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, no) by place: what each of the bounds keeps if every place belongs to the first of them over it. n log n."""
    begins = sorted(range(len(bounds)), key=lambda i: bounds[i][0])
    points, out, live, k = sorted({p for b in bounds for p in b}), [], [], 0
    for a, b in zip(points, points[1:]):  # noqa: B905, RUF007
        while k < len(begins) and bounds[begins[k]][0] <= a:
            heapq.heappush(live, begins[k])
            k += 1
        while live and bounds[live[0]][1] <= a:
            heapq.heappop(live)
        if live and out and out[-1][1] == a and out[-1][2] == live[0]:
            out[-1] = out[-1][0], b, live[0]
        elif live:
            out.append((a, b, live[0]))
    return out


def _reach(spans: list[Span]) -> Callable[[int, str], int]:
    """The furthest end among spans that begin at or before a place and have another label."""
    ordered = sorted(spans)
    starts, best, first, second = [s.start for s in ordered], [], (-1, ""), (-1, "")
    for s in ordered:
        if s.label == first[1]:
            first = max(first, (s.end, s.label))
        elif s.end > first[0]:
            first, second = (s.end, s.label), first
        elif s.end > second[0]:
            second = s.end, s.label
        best.append((first, second))

    def to(place: int, label: str) -> int:
        k = bisect_right(starts, place)
        return -1 if not k else best[k - 1][0][0] if best[k - 1][0][1] != label else best[k - 1][1][0]

    return to


def alternatives(ranked: list[Span]) -> list[Span]:
    """Without a model's spans that a clearly longer one of another label holds, and of one label those that hold, or are in, a better one."""
    model = [s for s in ranked if s.source == "model"]
    if len(model) < 2:
        return ranked
    to, kept, sides = _reach(model), [], {}
    for s in ranked:
        if s.source == "model":
            if any(to(s.start - k, s.label) >= s.end + 2 - k for k in (0, 1, 2)):
                continue
            # Kept spans of a label don't hold each other, so starts and ends rise together.
            own = sides.setdefault(s.label, [])
            i = bisect_right(own, (s.start, float("inf")))
            j = bisect_left(own, (s.start, -1))
            if (i and own[i - 1][1] >= s.end) or (j < len(own) and own[j][1] <= s.end):
                continue
            insort(own, (s.start, s.end))
        kept.append(s)
    return kept


def trimmed(whole: str, start: int, end: int) -> tuple[int, int]:
    if start < end and not whole[start].isspace() and not whole[end - 1].isspace():
        return start, end
    while start < end and whole[start].isspace():
        start += 1
    while end > start and whole[end - 1].isspace():
        end -= 1
    return start, end


def is_area(whole: str, s: Span) -> bool:
    if s.label != "AMOUNT":
        return False
    value = whole[s.start : s.end]
    return bool(_compiled(patterns.QUANTITY).fullmatch(value)) and bool(_compiled(patterns.AREA_END).search(value) or _compiled(patterns.AREA).match(whole[s.end : s.end + 12]))


def _clusters(bounds: list[tuple[int, int]]) -> Iterator[list[int]]:
    """The numbers of bounds in groups that share no character, by place; within a group in their order. Most spans stand alone, which takes no sweep."""
    group, reach = [], -1
    for i in sorted((i for i, (a, b) in enumerate(bounds) if a < b), key=bounds.__getitem__):
        if group and bounds[i][0] >= reach:
            yield sorted(group)
            group = []
        group.append(i)
        reach = max(reach, bounds[i][1])
    if group:
        yield sorted(group)


def fuse(whole: str, spans: Iterable[Span]) -> list[Span]:
    """Spans of all sources so that none overlap: each character belongs to the best ranked span over it, the others keep what is left of them.

    They come by place. A clipped span's canonical value is what is left. Areas are no amounts; general parts of names that clipping leaves go.
    """
    kept = [s for s in spans if s.label != "AMOUNT" or not is_area(whole, s)]
    if [s.source for s in kept].count("model") > 1:
        kept = alternatives(sorted(kept, key=rank))
    bounds, out = [trimmed(whole, s.start, s.end) for s in kept], []
    for group in _clusters(bounds):
        best = group[0] if len(group) == 1 else min(group, key=lambda i: rank(kept[i]))
        if all(bounds[best][0] <= bounds[i][0] and bounds[i][1] <= bounds[best][1] for i in group):
            pieces = [(*bounds[best], kept[best])]  # it leaves nothing of the others
        else:
            group.sort(key=lambda i: rank(kept[i]))
            pieces = [(*trimmed(whole, a, b), kept[group[no]]) for a, b, no in sweep([bounds[i] for i in group])]
        for start, end, s in pieces:
            if start == end:
                continue
            if (start, end) != (s.start, s.end):
                s = s._replace(start=start, end=end, clipped=True, canonical_value=whole[start:end] if s.canonical_value is not None else None)
                bare = "".join(whole[start:end].split())
                if (s.label in ("ORG", "ADDRESS") and len(bare) == 1) or (s.label == "ORG" and bare in patterns.CLIPPED_NAMES):
                    continue
            out.append(s)
    return out


def roles(whole: str, spans: list[Span], cues: dict[str, str]) -> list[str | None]:
    """The role of each span: the cue that ends nearest in front of a mention; the last mention with one speaks for all of its value."""
    said: dict[str, str] = {}
    for s in sorted(spans):
        if s.label in patterns.ROLE_LABELS:
            window = whole[max(0, s.start - patterns.ROLE_WINDOW) : s.start]
            near = [(len(window) - found[-1], i, role) for i, (role, cue) in enumerate(cues.items()) if (found := [m.end() for m in _compiled(cue).finditer(window)])]
            if near:
                said[whole[s.start : s.end]] = min(near)[2]
    return [said.get(whole[s.start : s.end]) if s.label in patterns.ROLE_LABELS else None for s in spans]


def outside(spans: list[Span], places: list[tuple[int, int]]) -> list[Span]:
    """The spans that share no character with any of the places, which don't overlap and come in order."""
    ends = [b for _, b in places]
    return [s for s in spans if (i := bisect_right(ends, s.start)) == len(places) or places[i][0] >= s.end]


def replaced(whole: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with (start, end, replacement), which don't overlap, in order, put in."""
    out, at = [], 0
    for start, end, value in spans:
        out += [whole[at:start], value]
        at = end
    return "".join([*out, whole[at:]])


def digest(value: str) -> str:
    return "sha256:" + hashlib.sha256(value.encode()).hexdigest()


def numbered(keys: Iterable[tuple[str, str]]) -> Iterator[str]:
    """A placeholder for each (prefix, value), numbered by prefix in the order in which values first appear."""
    names: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    for prefix, value in keys:
        if (prefix, value) not in names:
            counts[prefix] = counts.get(prefix, 0) + 1
            names[prefix, value] = f"<{prefix}_{counts[prefix]:03d}>"
        yield names[prefix, value]


def put_in(spans: Iterable[tuple[str, str | None, str, str | None]]) -> tuple[list[str], list[tuple[str, str, str, int]]]:
    """For (label, role, surface, coarse) in order: what each is replaced by, and the mapping (placeholder, label, value, n). What is generalised has a number but no way back."""
    spans = list(spans)
    names, mapped = list(numbered((role or patterns.PREFIXES.get(label, label), value) for label, role, value, _ in spans)), {}
    for name, (label, _, value, coarse) in zip(names, spans, strict=True):
        if coarse is None:
            old = mapped.get(name, (name, label, value, 0))
            mapped[name] = name, min(old[1], label), value, old[3] + 1
    return [name if s[3] is None else s[3] for name, s in zip(names, spans, strict=True)], sorted(mapped.values())


MAPPED = {"placeholder": "string", "label": "string", "original_value": "string", "n": "long"}
