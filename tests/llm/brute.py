"""Brute-force versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, words=2, percent=80):
    """rows: (doc_id, text). Returns {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids = sorted(sets)
    index = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            index[s].append(i)
    links = []
    for n, a in enumerate(ids):
        both = defaultdict(int)
        for s in sets[a]:
            for b in index[s]:
                if b > a:
                    both[b] += 1
        links += [(a, b) for b, k in both.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def recurring(rows, least=10):
    """rows: (doc_id, text). Returns {doc_id: numbers of the lines to drop}."""
    where = defaultdict(set)  # leaf -> documents; and (leaf, line) -> documents
    leaves = {}
    for i, t in rows:
        for no, raw in enumerate((t or "").split("\n")):
            if raw:
                line = tuple("<*>" if re.search("[0-9]", w) else w for w in raw.split(" "))
                at = [("whole", raw)]
                if len(line) > 1:
                    at += [(k, len(line), *(line[x] if x < len(line) else None for x in pair)) for k, pair in enumerate([(0, 1), (0, 2), (1, 2)])]
                leaves[i, no] = line, at
                for leaf in at:
                    where[leaf, line].add(i)
    support = defaultdict(set)
    for (leaf, line), docs in where.items():
        for pos, token in enumerate(line):
            support[leaf, pos, token] |= docs
    template = lambda leaf, line: tuple(w if w != "<*>" and len(support[leaf, pos, w]) >= least else "<*>" for pos, w in enumerate(line))
    have = defaultdict(set)
    for (leaf, line), docs in where.items():
        have[leaf, template(leaf, line)] |= docs
    out = {i: set() for i, _ in rows}
    for (i, no), (line, at) in leaves.items():
        for leaf in at:
            t = template(leaf, line)
            if leaf[0] == "whole":
                gone = len(set().union(*(d for (x, _), d in where.items() if x == leaf))) >= least
            else:
                gone = len(have[leaf, t]) >= least and sum(w != "<*>" for w in t) >= 0.5 * len(t)
            if gone:
                out[i].add(no)
    return out


def repeated(rows, window, units):
    """rows: (doc_id, text). Returns [(doc_id, units, removed flags)]."""
    first = {}
    split = [(i, units(t or "")) for i, t in rows]
    for i, u in split:
        for k in range(len(u) - window + 1):
            key = tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, u in split:
        gone = np.zeros(len(u), bool)
        for k in range(len(u) - window + 1):
            key = tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window]
            if first[key] < i:
                gone[k : k + window] = True
        out.append((i, u, gone))
    return out


def repeated_bytes(rows, window=50):
    out = []
    for i, u, gone in repeated(rows, window, lambda t: t.encode()):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(u, np.uint8)[~gone])
        out.append((i, len(u), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(rows, window=50):
    out = []
    for i, u, gone in repeated(rows, window, lambda t: WORD.findall(t)):
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        out.append((i, len(u), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    labels, places = set(), []
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def vector_links(rows, least=0.95):
    """rows: (vec_id, vector or None). Returns [(vec_id, n_links, component_id)]."""
    good = [(i, np.asarray(v, float)) for i, v in rows if v is not None and all(c is not None for c in v) and len(v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    ids = [i for i, _ in good]
    n, links = defaultdict(int), []
    if good:
        x = np.stack([v / np.linalg.norm(v) for _, v in good])
        s = x @ x.T
        for a, b in zip(*np.nonzero(s >= least)):
            if a != b:
                n[ids[a]] += 1
                links.append((ids[a], ids[b]))
    comp = components([i for i, _ in rows], links)
    return sorted((i, n[i], comp[i]) for i, _ in rows)


def edits(s, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        row, old = [i], row
        for j, d in enumerate(t, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def toxic_score(text, terms, weights, coefficients, allowed, window=5):
    """Each word's nearest term within its edits (whole words before stems, then the first), quoted or not, and the score of that."""
    spots = [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[0-9A-Za-z]+", text)]
    plain = fuzzy = quoted = 0.0
    for k, (word, a, b) in enumerate(spots):
        found = []
        for n, t in enumerate(terms):
            if t.endswith("*"):
                if word.startswith(t[:-1]):
                    found.append((0, 1, n))
            elif abs(len(word) - len(t)) <= allowed(t) and (d := edits(word, t)) <= allowed(t):
                found.append((d, 0 if allowed(t) else 1, n))
        if found:
            d, _, n = min(found)
            left, right = spots[max(0, k - window)][1], spots[min(len(spots) - 1, k + window)][2]
            if '"' in text[left:a] and '"' in text[b:right]:
                quoted += weights[n]
            elif d:
                fuzzy += weights[n] / (1 + d)
            else:
                plain += weights[n]
    x = [float(plain > 0), np.log1p(plain), np.log1p(fuzzy), np.log1p(quoted), (plain + fuzzy) / max(1, len(spots)), 1.0]
    return 1 / (1 + np.exp(-np.dot(x, coefficients)))
