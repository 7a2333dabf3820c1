"""Size budgets in closed form, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCAFFOLD, DEPTH_FACTOR, TYPE_FACTOR = {"study": 2250, "reference": 1700}, {"study": 1.0, "reference": 0.55}, {"text": 1.0, "technical": 1.45}
BASE, PER_ROOT, CAP_SECTIONS, CAP_STEP, TOLERANCE = 1050, 1500, 50, 500, 0.1
MASTER = {"base": 300, "book": 75, "capability": 350, "protocol": 900, "entry": 25, "entries": 600}
MASTER_STOP = 4500


def _by(key: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def reference_budget(sections: Column, depth: Column, kind: Column) -> Column:
    """Target tokens of a reference file; null for fewer than one section or unknown depth or kind."""
    body = (F.lit(float(BASE)) + F.lit(float(PER_ROOT)) * F.sqrt(sections.cast("double"))) * (_by(depth, DEPTH_FACTOR) * _by(kind, TYPE_FACTOR))
    return F.when(sections >= 1, F.bround(_by(depth, SCAFFOLD) + body).cast("int"))


def reference_cap(depth: Column, kind: Column) -> Column:
    """The budget of ``CAP_SECTIONS`` sections, rounded up to the next ``CAP_STEP``."""
    out = F.lit(None).cast("int")
    for d in SCAFFOLD:
        for t in TYPE_FACTOR:
            raw = round(SCAFFOLD[d] + (BASE + PER_ROOT * math.sqrt(CAP_SECTIONS)) * DEPTH_FACTOR[d] * TYPE_FACTOR[t])
            out = F.when((depth == d) & (kind == t), F.lit(math.ceil(raw / CAP_STEP) * CAP_STEP)).otherwise(out)
    return out


def master_budget(books: Column, capabilities: Column, entries: Column) -> Column:
    def some(n: Column) -> Column:
        return F.greatest(n, F.lit(0))

    index = F.least(some(entries) * MASTER["entry"], F.lit(MASTER["entries"]))
    return some(books) * MASTER["book"] + some(capabilities) * MASTER["capability"] + index + F.lit(MASTER["base"] + MASTER["protocol"])
