"""Plain versions that several tests compare with."""


def jaccard_loop(docs):
    def runs(text):
        found = (text or "").lower().split()
        size = min(5, len(found))
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()

    sets = [runs(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(d for (d, _), x in zip(docs, label) if x == g) for g in set(label))
