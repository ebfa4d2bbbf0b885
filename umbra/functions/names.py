"""What a task does with the names that a model finds in one text: their bounds are often off by a line end or a tail."""

from __future__ import annotations

import re
from typing import NamedTuple

from umbra.functions import patterns as p

_LINE, _BREAK = re.compile(r"[^\r\n]+"), re.compile(r"\r\n|\r|\n")
_RUN = re.compile(f"(?:(?![{re.escape(p.NAME_STOPS)}])[㐀-鿿\\d]){{0,{p.TAIL_WINDOW}}}")
_NEXT_LINE = re.compile(r"(?:\r\n|\r|\n)[ \t]*")
_PREDICATE, _HAN = re.compile(p.PREDICATE), re.compile("[㐀-鿿]")


class Name(NamedTuple):
    start: int
    end: int
    label: str
    score: float
    #: The name without the line end that breaks it; what moved its bounds.
    canonical: str | None = None
    repair: str | None = None


def _soft(between: str) -> bool:
    """One line end and blanks."""
    return not between.strip() and len(_BREAK.findall(between)) == 1


def lines(text: str, start: int, end: int, label: str) -> list[tuple[int, int]]:
    """The parts of a span by line, without blanks at their edges; two that a soft wrap cut in the middle of a name are one."""
    parts = []
    for m in _LINE.finditer(text, start, end):
        left, right = len(m[0]) - len(m[0].lstrip(" \t")), len(m[0].rstrip(" \t"))
        if left < right:
            parts.append((m.start() + left, m.start() + right))
    if len(parts) == 2 and len(_BREAK.findall(text[parts[0][1] : parts[1][0]])) == 1:
        first, second = (text[a:b] for a, b in parts)
        both = first + second
        short = len(second) <= 2
        joined = label == "ADDRESS" and short and both.endswith(p.WRAPPED_ADDRESSES)
        joined |= label == "ORG" and not first.endswith(p.WHOLE_ORGS) and both.endswith(p.WRAPPED_ORGS) and (short or p.WRAPPED_AUTHORITY in both)
        if joined:
            return [(parts[0][0], parts[1][1])]
    return parts


def extended(text: str, start: int, end: int, label: str) -> int:
    """The end of the longest name that ends in a structural tail, within a run of name characters; else a tail at the start of the next line."""
    tails = p.ADDRESS_TAILS if label == "ADDRESS" else p.ORG_TAILS
    run = _RUN.match(text, end)[0]
    for k in range(len(run), 0, -1):
        if text[start : end + k].endswith(tails):
            return end + k
    wrap = _NEXT_LINE.match(text, end)
    if wrap and label == "ORG" and not text[start:end].endswith(p.WHOLE_ORGS):
        return next((wrap.end() + len(t) for t in p.NEXT_LINE_TAILS if text.startswith(t, wrap.end())), end)
    if wrap and label == "ADDRESS":
        for k in (1, 2):
            more = text[wrap.end() : wrap.end() + k]
            if len(more) < k or not re.fullmatch(r"[㐀-鿿\d]+", more):
                break
            if (text[start:end] + more).endswith(p.ADDRESS_TAILS):
                return wrap.end() + k
    return end


def trimmed(text: str, n: Name) -> Name | None:
    """Without quotes and blanks at its edges and, for a company, without the predicate behind it."""
    whole = text[n.start : n.end]
    start = n.start + len(whole) - len(whole.lstrip(p.NAME_EDGES))
    end = n.end - len(whole) + len(whole.rstrip(p.NAME_EDGES))
    if n.label == "ORG" and (m := _PREDICATE.search(text[start:end])) and m.start() >= 2:
        end = start + m.start()
    if end <= start:
        return None
    return n if (start, end) == (n.start, n.end) else n._replace(start=start, end=end, repair="trim_noise")


def rejoined(text: str, names: list[Name]) -> list[Name]:
    """Two halves that the model found on two lines are one name if only both together end as a name does."""
    out: list[Name] = []
    for n in names:
        last = out[-1] if out else None
        if last and last.repair != "line_wrap_pair" and last.label == n.label and n.label in ("ORG", "ADDRESS") and n.start >= last.end and _soft(text[last.end : n.start]):
            first, second = text[last.start : last.end], text[n.start : n.end]
            whole, most = (p.WHOLE_ORGS, 10) if n.label == "ORG" else (p.WRAPPED_ADDRESSES, 4)
            if not first.endswith(whole) and (first + second).endswith(whole) and len(second) <= most:
                out[-1] = Name(last.start, n.end, n.label, min(last.score, n.score), first + second, "line_wrap_pair")
                continue
        out.append(n)
    return out


def identity(text: str, n: Name) -> str:
    return "".join((n.canonical or text[n.start : n.end]).split())


def _grown(text: str, n: Name, known: dict[int, set[str]]) -> Name:
    """The longest known name around a span, by length and then by value; blanks and one line end may break it."""
    own = identity(text, n)
    first = max(0, n.start - p.REPEAT_WINDOW)
    at = [i for i in range(first, min(len(text), n.end + p.REPEAT_WINDOW)) if not text[i].isspace()]
    packed = "".join(text[i] for i in at)
    for size in sorted((k for k in known if k > len(own)), reverse=True):
        met = sorted((packed[i : i + size], i) for i in range(len(packed) - size + 1) if packed[i : i + size] in known[size] and own in packed[i : i + size])
        for value, i in met:
            start, end = at[i], at[i + size - 1] + 1
            if start <= n.start and n.end <= end and len(_BREAK.findall(text[start:end])) <= 1:
                return n._replace(start=start, end=end, canonical=value, repair="repeated_surface")
    return n


def repeated(text: str, names: list[Name]) -> list[Name]:
    """A name that stands in the text as part of one found elsewhere as a whole takes its bounds; an address that is a company elsewhere is one."""
    known: dict[str, dict[int, set[str]]] = {"ORG": {}, "ADDRESS": {}}
    for n in names:
        value = identity(text, n)
        if n.label in known and len(value) >= 3 and value not in p.NOBODY[n.label]:
            known[n.label].setdefault(len(value), set()).add(value)
    grown = [_grown(text, n, known[n.label]) if n.label in known else n for n in names]
    companies = {identity(text, n) for n in grown if n.label == "ORG"}
    is_company = lambda v: v in companies and not v.endswith(p.WRAPPED_ADDRESSES)
    return [n._replace(label="ORG", repair="cross_label_surface") if n.label == "ADDRESS" and is_company(identity(text, n)) else n for n in grown]


def universities(text: str, names: list[Name]) -> list[Name]:
    """A company that ends in 大 before 学 takes it, with an address of that one character; an address that ends in 大学 is a company."""
    out: list[Name] = []
    taken = None
    for n in names:
        whole = text[n.start : n.end]
        if taken is not None and n.label == "ADDRESS" and (n.start, n.end) == taken:
            out[-1] = out[-1]._replace(score=min(out[-1].score, n.score))
            taken = None
            continue
        taken = None
        if n.label == "ORG" and whole.endswith("大") and text[n.end : n.end + 1] == "学":
            taken = n.end, n.end + 1
            n = n._replace(end=n.end + 1, repair="university_suffix")
        elif n.label == "ADDRESS" and whole.endswith("大学"):
            n = n._replace(label="ORG", repair="university_label")
        out.append(n)
    return out


def names_somebody(text: str, n: Name) -> bool:
    """Two Han characters at least, and no general name or public body."""
    value = "".join(text[n.start : n.end].split())
    if len(_HAN.findall(value)) < 2 or value in p.NOBODY.get(n.label, ()):
        return False
    bare = value.replace("、", "").replace("，", "")
    return not (n.label == "ORG" and (value.endswith(p.PUBLIC_TAILS) or (len(bare) >= 2 and any(bare in form for form in p.PUBLIC_FORMS))))


def found(text: str, given: list[tuple[int, int, str, float]]) -> list[Name]:
    """A model's spans (start, end, label, score), each once: split by lines and extended to their tails."""
    out: dict[tuple, Name] = {}
    for start, end, label, score in given:
        for a, b in lines(text, start, end, label):
            b = extended(text, a, b, label) if label in ("ORG", "ADDRESS") else b
            surface = text[a:b]
            out.setdefault((a, b, label), Name(a, b, label, score, _BREAK.sub("", surface) if _BREAK.search(surface) else None))
    return list(out.values())


def repaired(text: str, given: list[Name]) -> list[Name]:
    """All repairs in order; of equal bounds and label the first stays."""
    order = lambda n: n[:3]
    names = sorted((t for n in given if (t := trimmed(text, n))), key=order)
    names = universities(text, sorted(repeated(text, rejoined(text, names)), key=order))
    kept = {}
    for n in names:
        if names_somebody(text, n):
            kept.setdefault(n[:3], n)
    return list(kept.values())
