"""Brute force that several tests share."""

import numpy as np


def contaminated(texts, items):
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    out = []
    for text in texts:
        w, found = tokens(text), set()
        for item, target in items:
            b = tokens(target)
            n = min(13, len(b))
            if n < 5:
                continue
            need = n if len(b) < 9 else int(np.ceil(0.8 * n - 1e-9))
            if any(sum(x == y for x, y in zip(w[i : i + n], b[j : j + n])) >= need for j in range(len(b) - n + 1) for i in range(len(w) - n + 1)):
                found.add(item)
        out.append(found)
    return out
