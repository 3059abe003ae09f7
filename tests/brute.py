"""Straightforward Python versions of a few rules, for comparison only."""


def split(text, size, overlap):
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while True:
        stop = min(at + size, len(text))
        if stop < len(text):
            window = text[max(at, stop - size // 4) : stop]
            ends = [i for i in range(len(window)) if window[i : i + 2] in (". ", "! ", "? ")]
            ends += [i for i, ch in enumerate(window) if ch == "\n"]
            if ends:
                cut = max(at, stop - size // 4) + max(ends)
                if cut > at + size // 2:
                    stop = cut + 1
        parts.append(text[at:stop].strip())
        if stop == len(text):
            return [p for p in parts if p]
        at = max(0, stop - overlap)


def parents(elements, limit=1200, overlap=150, section_min=400, table_limit=3000):
    """(parent text, type, page, section) of (text, type, page, section) elements."""
    out, held, meta = [], [], None

    def flush():
        if held:
            out.append(("\n".join(held), *meta))
            held.clear()

    for text, kind, page, section in elements:
        text = (text or "").strip()
        if not text:
            continue
        size = len("\n".join(held))
        if kind in ("Title", "Section") and held and size >= min(section_min, limit):
            flush()
        if kind == "Table" or len(text) > limit:
            flush()
            whole = kind == "Table" and len(text) <= table_limit
            pieces = [text] if whole else split(text, limit, overlap)
            out.extend((p, kind, page, section) for p in pieces)
            continue
        if held and len("\n".join([*held, text])) > limit:
            flush()
        if not held:
            meta = (kind, page, section)
        held.append(text)
    flush()
    return out


def chunks(elements, cap=100, **rules):
    found = [
        (child, parent, kind, page, section)
        for parent, kind, page, section in parents(elements, **rules)
        for child in split(parent, 300, 50)
    ]
    return [(i, *c) for i, c in enumerate(found[:cap])]


def sections(elements):
    """Last title before each (text, type) element."""
    out, current = [], None
    for text, kind in elements:
        out.append(current)
        if kind in ("Title", "Section"):
            current = text[:200]
    return out


def rrf(fts, vec):
    scores = {}
    for rank, key in enumerate(fts):
        boost = {0: 3.0, 1: 2.0}.get(rank, 1.0) if key in vec[:8] else 1.0
        scores[key] = scores.get(key, 0) + boost / (61 + rank)
    for rank, key in enumerate(vec):
        scores[key] = scores.get(key, 0) + 1.5 / (61 + rank)
    return scores
