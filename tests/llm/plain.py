"""Plain versions of the manifest and of conversation repair."""

from __future__ import annotations

import hashlib
import re
import zlib

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows) -> list[tuple]:
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(part, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    by: dict = {}
    for r in rows:
        by.setdefault((r.source is not None, (r.source or "").encode()), []).append(r)
    for s in by:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees, order = {s: tree([leaf(r, r.text) for r in by[s]]) for s in by}, sorted(by)
    top, out = tree([trees[s][-1][0] for s in order]), []
    for n, s in enumerate(order):
        for k, r in enumerate(by[s]):
            own, siblings = leaf(r, r.text), []
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            d = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) if changed else own
            for levels, at in ((trees[s], k), (top, n)):
                for level in levels[:-1]:
                    b = at - at % 16
                    left, right = level[b:at], level[at + 1 : b + 16]
                    siblings, d, at = siblings + left + right, sha(*left, d, *right), at // 16
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], sha(*siblings), d, d == top[-1][0]))
    return out


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]], list[str]]:
    """All edit sequences up to the cheapest cost, by recursion: cost, least audit, what stays, faults."""
    seen, faults = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(turns)

    def moves(i, state):
        for x, name in (("u", "user"), ("a", "assistant")):
            if (state, x) in NEXT:
                yield 3, "I", i, NEXT[state, x], (name, "")
        if i < n:
            role, text = turns[i]
            yield 4, "D", i + 1, state, None
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    yield more, "K", i + 1, NEXT[state, role[:1]], (role, text)
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in NEXT:
                        yield more + 3, "R", i + 1, NEXT[state, x], (name, text)

    for bound in range(4 * n + 1):
        found = []

        def walk(i, state, paid, audit, out):
            if paid > bound:
                return
            if i == n and state in (0, 3):
                found.append((paid, audit, out))
            for price, letter, j, to, kept in moves(i, state):
                walk(j, to, paid + price, audit + letter, out if kept is None else [*out, kept])

        walk(0, 0, 0, "", [])
        if found:
            return (*min(found), faults)


def repair(rows: list[tuple]) -> dict:
    by: dict = {}
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else str(v)
        roll, role, text = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20, plain(role), plain(text)
        by.setdefault(conv, [])
        if roll:
            text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
            by[conv] += [(turn, "user" if roll == 4 else role, text)] * (2 if roll == 3 else 1)
    out = {}
    for conv, r in by.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        cost, audit, kept, faults = cheapest([x[1:] for x in r])
        turns, initials = [x[0] for x in r if x[0] is not None], [x[1][:1] for x in r]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(f"{x}:{y}" for x, y in kept)))
    return out
