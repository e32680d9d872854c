"""Plain-Python versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "rep bucket component_id kept keep_id sha text_sha256 size source_size row id label mix quality toxicity language site scan tokens n_shingles".split()


def documents(spark, rows, clashing=True):
    """(doc_id, text, lang, source) rows as a documents table, with extra columns whose names operators use inside."""
    width = 4
    rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if clashing:
        for c in CLASHING:
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def exact_groups(rows):
    groups = {}
    for id, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), id is None, id))
    out = []
    for id, text in rows:
        group = groups[plain(text)]
        keep = min(group)[2]
        out.append((id, keep, len(group), id == keep, hashlib.sha256(plain(text).encode()).hexdigest()))
    return out


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_components(rows, k, percent=80):
    sets = [(id, shingles(text, k)) for id, text in rows]
    parent = {id: id for id, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(id, len(s), root(id), root(id) == id) for id, s in sets]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Target by source for {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: weight[s] * left / sum(weight[o] for o in open_) for s in open_}
        more = {s for s in open_ if share[s] > ceiling * sizes[s]}
        if not more:
            return {s: share.get(s, float(ceiling * sizes[s])) for s in order}
        full |= more


def draw(id, text, seed="mix"):
    own = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{seed}:{'' if id is None else id}:{own}".encode()).hexdigest()[:15], 16) / float(1 << 60)
