"""Plain Python forms of the text rules, written for the tests from the rules."""

import math
import re

TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[a-zA-Z_][a-zA-Z0-9_]*|\d+\.?\d*|[^\s\w]|\s+""")
MATH = re.compile(r"\$\$.*?\$\$|\$.*?\$", re.S)


def tokens(text):
    spans = MATH.findall(text)
    count = iter(range(len(spans)))
    text = MATH.sub(lambda m: f" __MATH_{next(count)}__ ", text)
    out = []
    for t in TOKEN.findall(text):
        if t[0].isspace():
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(t)
    names = {f"__MATH_{k}__": s for k, s in enumerate(spans)}
    return [names.get(t, t) for t in out]


def rebuild(kept):
    parts = []
    for t in (x.strip() for x in kept):
        if t and (not parts or parts[-1] != t):
            parts.append(t)
    return "".join(p if k == 0 or p[0] in ",.:;)]}?!'\"" else " " + p for k, p in enumerate(parts))


def quenched(rows, alpha, theta, least, t0=1.0):
    """rows: (token, energy, frozen) in order. Step by step, as the rule says."""
    n = len(rows)
    best, sim, tau = list(range(n)), 1.0, 0
    if n < least:
        return best, sim, tau
    energy = {t: e for t, e, _ in rows}
    total = sum(energy[t] for t, _, _ in rows)
    free = [i for i in range(n) if not rows[i][2]]
    order = sorted(free, key=lambda i: (-round(rows[i][1], 12), i))
    for step in range(1, 101):
        part = min(1.0, (t0 / (1.0 + alpha * step)) / t0)
        kept = sorted([i for i in range(n) if rows[i][2]] + order[: max(1, math.ceil(len(order) * part)) if order else 0])
        if len(free) < n:
            s = 1.0
        elif total == 0:
            s = len(kept) / n
        else:
            s = min(1.0, sum(energy[rows[i][0]] for i in kept) / total)
        if round(s, 12) < theta:
            break
        best, sim, tau = kept, s, step
    return best, sim, tau


def boltzmann_quenched(rows, alpha, theta, least, t0, k, number):
    """rows: (token, energy, frozen). number(step, trial): a number for each place.
    Step by step, as the rule says."""
    n = len(rows)
    everything = list(range(n))
    best, sim, tau = everything, 1.0, 0
    if n < least:
        return best, sim, tau
    energy = {t: e for t, e, _ in rows}
    total = sum(energy[t] for t, _, _ in rows)
    free = [i for i in range(n) if not rows[i][2]]
    order = sorted(free, key=lambda i: (-round(rows[i][1], 12), i))

    def fidelity(kept):
        if len(free) < n:
            return 1.0
        return min(1.0, sum(energy[rows[i][0]] for i in kept) / total) if total else len(kept) / n

    for step in range(1, 101):
        heat = t0 / (1.0 + alpha * step)
        chosen, top = None, 0.0
        for trial in range(5):
            u = number(step, trial)
            kept = [i for i in everything if rows[i][2] or math.exp(-rows[i][1] / (k * heat)) >= u[i]]
            if len(kept) <= len(best):
                continue
            if round(fidelity(kept), 12) >= theta and fidelity(kept) > top:
                chosen, top = kept, fidelity(kept)
        if chosen is None:
            chosen = sorted([i for i in everything if rows[i][2]] + order[: max(1, math.ceil(len(order) * min(1.0, heat / t0))) if order else 0])
        s = fidelity(chosen)
        if round(s, 12) < theta:
            break
        best, sim, tau = chosen, s, step
    return best, sim, tau
