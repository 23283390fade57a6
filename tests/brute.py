"""Small one-by-one versions of the methods, for comparison."""

import numpy as np


def pairwise(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def dbscan(x, eps, min_samples):
    near = pairwise(x) <= eps
    core = near.sum(1) >= min_samples
    labels, found = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i], todo = found, [i]
        while todo:
            for k in np.nonzero(near[todo.pop()])[0]:
                if labels[k] == -1:
                    labels[k] = found
                    if core[k]:
                        todo.append(k)
        found += 1
    return labels


def ward(x, threshold):
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > 1:
        keys = sorted(groups)
        best = min(
            (np.sqrt(2 * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])))
             * np.linalg.norm(x[groups[a]].mean(0) - x[groups[b]].mean(0)), a, b)
            for n, a in enumerate(keys) for b in keys[n + 1:]
        )
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    labels = np.zeros(len(x), dtype=int)
    for n, key in enumerate(sorted(groups)):
        labels[groups[key]] = n
    return labels


def meanshift(x, bandwidth):
    bins = np.unique(np.round(x / bandwidth) * bandwidth + 0.0, axis=0)
    seeds = x if len(bins) == len(x) else bins
    modes = {}
    for seed in seeds:
        for turn in range(301):
            near = x[np.linalg.norm(x - seed, axis=1) <= bandwidth]
            if len(near) == 0:
                break
            old, seed = seed, near.mean(0)
            if np.linalg.norm(seed - old) <= 1e-3 * bandwidth or turn == 300:
                modes[tuple(seed)] = len(near)
                break
    ordered = [np.array(m) for m, _ in sorted(modes.items(), key=lambda m: (m[1], m[0]), reverse=True)]
    kept = []
    for mode in ordered:
        if all(np.linalg.norm(mode - k) > bandwidth for k in kept):
            kept.append(mode)
    return np.array([np.argmin([np.linalg.norm(p - k) for k in kept]) for p in x])


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def silhouette(x, labels):
    d, scores = pairwise(x), []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) if other != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def hdbscan(x, min_size, min_samples):
    """Labels (as roots) and probabilities from components at every threshold."""
    d = pairwise(x)
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(reach, np.inf)
    group = list(range(len(x)))  # component of each row, merged as the threshold rises
    node = {}  # component -> cluster
    leave, parent, sizes = {}, {}, {}
    for m in np.unique(reach[np.isfinite(reach)]):
        old, todo, new = group[:], set(range(len(x))), {}
        adjacent = reach <= m
        while todo:
            stack, seen = [todo.pop()], set()
            while stack:
                i = stack.pop()
                seen.add(i)
                near = {int(k) for k in np.nonzero(adjacent[i])[0]} & todo
                todo -= near
                stack.extend(near)
            for i in seen:
                group[i] = min(seen)
            new[min(seen)] = seen
        fresh = {}
        for root, rows in new.items():
            inner = {node[c] for c in {old[i] for i in rows} if c in node}
            if len(rows) < min_size:
                continue
            name = inner.pop() if len(inner) == 1 else len(sizes) + 1000
            for child in inner - {name}:
                parent[child] = (name, m)
            sizes[name] = len(rows)
            for i in rows:
                leave.setdefault(i, (m, name))
            fresh[root] = name
        node = fresh
    birth = {c: 1 / parent[c][1] if c in parent else 0.0 for c in sizes}
    own = {c: 0.0 for c in sizes}
    death = {c: 0.0 for c in sizes}
    below = {c: [k for k, (p, _) in parent.items() if p == c] for c in sizes}
    count = {c: sum(1 for _, n in leave.values() if n == c) for c in sizes}

    def total(c):
        return count[c] + sum(total(k) for k in below[c])

    for m, c in leave.values():
        own[c] += 1 / m - birth[c]
        death[c] = max(death[c], 1 / m)
    for child, (c, m) in parent.items():
        own[c] += total(child) * (1 / m - birth[c])
        death[c] = max(death[c], 1 / m)

    def best(c):
        if not below[c]:
            return own[c], {c}
        parts = [best(k) for k in below[c]]
        inner = sum(p[0] for p in parts)
        if inner > own[c] or c not in parent:
            return inner, set().union(*[p[1] for p in parts])
        return own[c], {c}

    tops = [c for c in sizes if c not in parent]
    chosen = best(tops[0])[1] - set(tops) if tops else set()
    labels, share = np.full(len(x), -1), np.zeros(len(x))
    for i, (m, c) in leave.items():
        while c not in chosen and c in parent:
            c = parent[c][0]
        if c in chosen:
            labels[i], share[i] = c, min(1 / m, death[c]) / death[c]
    return labels, share
