"""Functions that SQL lacks, as expressions."""

from __future__ import annotations

from tessitura.operators import metrics as M


def _ratio(c: tuple, x: str) -> str:
    def horner(v: tuple) -> str:
        out = repr(v[-1])
        for k in reversed(v[:-1]):
            out = f"({out} * {x} + {k!r})"
        return out

    return f"{horner(c[0])} / {horner(c[1])}"


def sql_probit(p: str) -> str:
    """Normal quantile of an expression in (0, 1), by the same published approximation."""
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"case when {r} <= 5 then {_ratio(M.NEAR, f'({r} - 1.6)')} else {_ratio(M.FAR, f'({r} - 5)')} end"
    return f"(case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {_ratio(M.CENTRE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} else sign({p} - 0.5) * {tail} end)"
