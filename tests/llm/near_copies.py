"""Groups of near copies by comparing all pairs."""


def five_word_sets(texts):
    """The distinct five-word shingles of each text, found without the operators."""
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def brute_near_groups(texts, similarity=0.8):
    sets, root = five_word_sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a | b and len(a & b) >= similarity * len(a | b) - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]
