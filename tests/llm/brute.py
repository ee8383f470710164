"""Plain versions of what the operators compute, for small inputs."""

from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_duplicate_groups(rows, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in holders[x]:
                both[(j, i)] += 1
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
