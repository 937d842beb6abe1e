"""Sequential models the distributed operators are compared with."""

import re


def fold(lines, starts, ends, explicit, schemaless=False):
    """[(line_no, raw)] of one source; ``starts`` and ``ends`` are Python patterns."""
    out, current = [], None
    for no, line in enumerate(lines, 1):
        if current is None and explicit and not line.strip():
            continue
        begins = schemaless or any(re.search(p, line) for p in starts)
        if current is not None and not begins:
            current[1] += "\n" + line
        else:
            if current:
                out.append(tuple(current))
            current = [no, line]
        if any(re.search(p, line) for p in ends):
            out.append(tuple(current))
            current = None
    if current:
        out.append(tuple(current))
    return out
