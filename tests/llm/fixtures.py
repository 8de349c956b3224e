"""Small tables with awkward rows, and brute-force versions of what operators compute."""

import re

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, score double, n long, spans string, label int, source string"


def near_duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component)} from (doc_id, text) by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sets:
        counts = {}
        for x in sets[i]:
            for j in holders[x]:
                if j > i:
                    counts[j] = counts.get(j, 0) + 1
        for j, c in counts.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
