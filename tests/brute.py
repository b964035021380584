"""Dense, slow versions of the clustering maths, for small fixtures only."""

import numpy as np


def binary_matrix(posts):
    """posts: list of term lists -> 0/1 matrix."""
    vocab = sorted({t for p in posts for t in p})
    col = {t: i for i, t in enumerate(vocab)}
    out = np.zeros((len(posts), len(vocab)))
    for i, p in enumerate(posts):
        out[i, [col[t] for t in p]] = 1
    return out


def cosine_distances(posts):
    x = binary_matrix(posts)
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    z = np.where(norm > 0, z / np.where(norm > 0, norm, 1), 0)
    d = 1 - z @ z.T
    np.fill_diagonal(d, 0)
    return d


def profile_distances(d):
    return np.sqrt(((d[:, None, :] - d[None, :, :]) ** 2).sum(axis=2))


def average_linkage(e, cut):
    """Greedy: merge the nearest two clusters until none are within the cut. Sets of row numbers."""
    groups = [[i] for i in range(len(e))]
    while len(groups) > 1:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                avg = round(float(e[np.ix_(groups[a], groups[b])].mean()), 9)
                if best is None or avg < best[0]:
                    best = (avg, a, b)
        if best[0] > round(cut, 9):
            break
        _, a, b = best
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def near_copies(rng, n, stories, words, edit, long_tail):
    """Posts cut from a few word sequences, some terms dropped or swapped."""
    base = [[f"s{s}w{k}" for k in range(rng.integers(6, words))] for s in range(stories)]
    out = []
    for _ in range(n):
        s = base[rng.choice(stories, p=np.arange(stories, 0, -1) / np.arange(1, stories + 1).sum())]
        post = {t for t in s if rng.random() > edit}
        post |= {f"x{rng.integers(long_tail)}" for _ in range(rng.integers(0, 3))}
        while len(post) < 5:
            post.add(s[rng.integers(len(s))] if rng.random() < .5 else f"x{rng.integers(long_tail)}")
        out.append(sorted(post))
    return out
