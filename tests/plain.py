"""Plain, slow versions of the operators, written from the problem statements."""

import re
from collections import defaultdict


def packed_values(text):
    out, i = [], 0
    while text is not None and i < len(text):
        c = text[i]
        if c in " \t,;|/":
            i += 1
        elif c in "\"'" and (j := text.find(c, i + 1)) >= 0:
            if j > i + 1:
                out.append(text[i + 1 : j])
            i = j + 1
        else:
            j = i
            while j < len(text) and text[j] not in " \t,;|/":
                j += 1
            out.append(text[i:j])
            i = j
    return out


def line_reason(line):
    """None for a sound line, '' for what is no data line."""
    if line is None:
        return ""
    line = line.removesuffix("\r")
    if not line.strip() or line.startswith("#"):
        return ""
    c = line.split("\t")
    if len(c) != 9:
        return "columns"
    if any('"' in x for x in c[:8]):
        return "quoting"
    pieces, cur, quoted = [], "", False
    for ch in c[8]:
        if ch == '"':
            quoted = not quoted
        if ch == ";" and not quoted:
            pieces.append(cur)
            cur = ""
        else:
            cur += ch
    pieces = [p.strip(" ") for p in [*pieces, cur] if p.strip(" ")]
    if c[8].strip() != ".":
        for p in pieces:
            k, eq, v = p.partition("=")
            if '"' in k or '"' in v and not re.fullmatch(r'"([^"]|"")*"', v):
                return "quoting"
    if not all(c) or any(not x.strip(" ") for x in c):
        return "value"
    if not (re.fullmatch("[0-9]+", c[3]) and re.fullmatch("[0-9]+", c[4]) and 1 <= int(c[3]) <= int(c[4])):
        return "value"
    if c[5] != "." and not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", c[5], re.A):
        return "value"
    if c[6] not in ("+", "-", ".", "?") or c[7] not in ("0", "1", "2", ".") or c[2] == "CDS" and c[7] == ".":
        return "value"
    if re.search("%(?![0-9A-Fa-f]{2})", c[8]):
        return "value"
    if c[8].strip() != ".":
        if not pieces:
            return "value"
        for p in pieces:
            k, eq, v = p.partition("=")
            if not eq or not k.strip() or not v.strip() or v == '""':
                return "value"
            if k.strip(" ") == "accession" and not re.fullmatch(r"[A-Z]{2}_[0-9]+\.[0-9]+", re.sub('^"|"$', "", v)):
                return "value"
    return None


def periods(rows):
    """rows: (file, seqid, ident, start, end) -> {(file, seqid, kind, start, end)}."""
    by = defaultdict(set)
    for f, q, i, s, e in rows:
        if q is not None and s is not None and e is not None and s <= e:
            by[f, q].add((s, e, str(i)))
    out = []
    for (f, q), xs in by.items():
        isles = []
        for s, e, _ in sorted(xs):
            if isles and s <= isles[-1][1]:
                isles[-1][1] = max(isles[-1][1], e)
                isles[-1][2] += 1
            else:
                isles.append([s, e, 1])
        out += [(f, q, "period", s, e) for s, e, n in isles if n > 1]
        out += [(f, q, "gap", x[1] + 1, y[0] - 1) for x, y in zip(isles, isles[1:]) if y[0] - x[1] > 1]
    return sorted(out, key=str)


def hierarchy(links, nodes):
    """links: {(child, parent)} among nodes. -> rows (node, root, depth) of all depths, cycles with -1."""
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)
    reach = {}
    for n in nodes:
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        reach[n] = seen
    cyclic = {n for n in nodes if n in reach[n]}
    out = []
    for n in cyclic:
        out.append((n, min((m for m in reach[n] if n in reach[m]), key=lambda s: s.encode()), -1))
    memo = {}

    def chains(n):
        if n not in memo:
            if not up[n]:
                memo[n] = {n: 0}
            else:
                d = {}
                for p in up[n]:
                    for r, k in chains(p).items():
                        d[r] = max(d.get(r, 0), k + 1)
                memo[n] = d
        return memo[n]

    for n in nodes:
        if n not in cyclic and not reach[n] & cyclic:
            out += [(n, r, k) for r, k in chains(n).items()]
    return sorted(out)
