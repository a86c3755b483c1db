"""Markdown of metrics: a report is titled tables, whose rows are few and come from the driver.

Rendering rules: numbers with fixed places, ``-`` for what is undefined, a difference as that of
the two numbers as they are shown, signs as + and the minus sign U+2212.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

MINUS = "\N{MINUS SIGN}"
UNDEFINED = "-"


@dataclass(frozen=True)
class Places:
    """Writes numbers of one kind: with so many decimals, times ``scale``, and a unit behind."""

    decimals: int = 3
    scale: float = 1.0
    unit: str = ""

    def _shown(self, x: float) -> Decimal:
        return Decimal(format(x * self.scale, f".{self.decimals}f"))

    def value(self, x: float | None) -> str:
        return UNDEFINED if x is None else f"{self._shown(x)}{self.unit}"

    def signed(self, x: Decimal) -> str:
        return ("+" if x >= 0 else MINUS) + str(abs(x))

    def less(self, a: float | None, b: float | None) -> str:
        return UNDEFINED if a is None or b is None else self.signed(self._shown(a) - self._shown(b))

    def span(self, low: float | None, high: float | None) -> str:
        return UNDEFINED if low is None or high is None else f"{self.signed(self._shown(low))} to {self.signed(self._shown(high))}"

    def difference(self, a: float | None, b: float | None, row: dict) -> str:
        """a less b, with the interval that ``row`` holds."""
        return f"{self.less(a, b)} ({self.span(row.get('low'), row.get('high'))})"


THREE, TWO, PERCENT = Places(3), Places(2), Places(0, 100, "%")
POINTS = Places(1, 100, "%")


@dataclass
class Table:
    """Columns by name, each with a function that writes its cell of a row."""

    columns: dict[str, Callable[[dict], object]]
    rows: list[dict] = field(default_factory=list)

    def markdown(self) -> str:
        return grid(self.columns, ([write(r) for write in self.columns.values()] for r in self.rows))


def grid(header: Iterable[str], rows: Iterable[Sequence[object]]) -> str:
    cells = [list(header), *(list(map(str, r)) for r in rows)]
    cells.insert(1, ["---"] * len(cells[0]))
    return "\n".join("| " + " | ".join(r) + " |" for r in cells)


def judge_table(rows: Iterable[dict]) -> str:
    """One line per route of ``judge_metrics``; a route with an error shows that."""

    def part(name: str, places: Places = THREE) -> Callable[[dict], str]:
        return lambda r: "" if r.get("error") else places.value(r.get(name))

    def best(r: dict) -> str:
        return "" if r.get("error") else f"{THREE.value(r.get('best_f1'))} ({TWO.value(r.get('best_f1_threshold'))})"

    def half(r: dict) -> str:
        known = not r.get("error") and r.get("precision_at_half") is not None
        return f"{THREE.value(r['precision_at_half'])} / {THREE.value(r['recall_at_half'])}" if known else UNDEFINED

    columns = {
        "route": lambda r: r["route"],
        "PR-AUC": lambda r: r["error"] if r.get("error") else THREE.value(r.get("pr_auc")),
        "ROC-AUC": part("roc_auc"),
        "ROC-AUC by query": part("per_query_roc_auc"),
        "best F1 (threshold)": best,
        "P / R at 0.5": half,
        "ECE": part("ece"),
        "Brier": part("brier"),
        "pairs": lambda r: r.get("pairs") or "",
    }
    return Table(columns, list(rows)).markdown()


def comparison_table(rows: Iterable[dict], baseline: str, metrics: Iterable[str]) -> str:
    """Mean, standard error and difference to the baseline of each metric."""
    rows = list(rows)
    base = next((r for r in rows if r["route"] == baseline and not r.get("error")), None)

    def cell(m: str) -> Callable[[dict], str]:
        def write(r: dict) -> str:
            if r.get("error"):
                return ""
            mean = f"{THREE.value(r[f'mean_{m}'])} ± {THREE.value(r[f'stderr_{m}'])}"
            return mean if base is None or r is base else f"{mean} ({THREE.less(r[f'mean_{m}'], base[f'mean_{m}'])})"

        return write

    columns = {"route": lambda r: r["route"], **{m: cell(m) for m in metrics}, "queries": lambda r: r.get("error") or r["n"]}
    if any(r.get("seconds") is not None for r in rows):
        columns |= {"seconds": lambda r: Places(1).value(r.get("seconds")), "failed": lambda r: UNDEFINED if r.get("failed") is None else r["failed"], "dropped": lambda r: UNDEFINED if r.get("dropped") is None else r["dropped"]}
    return Table(columns, rows).markdown()


def movers_table(rows: Iterable[dict]) -> str:
    columns = {"gain": lambda r: f"+{r['gain']}", **{c: lambda r, c=c: r[c] for c in ("was", "now", "query_id", "question")}}
    return Table(columns, list(rows)).markdown()


def answers_table(rows: Iterable[dict], baseline: str, paired: dict[str, dict] | None = None) -> str:
    """Answer accuracy by pipeline, with paired differences to the baseline where there are any."""
    rows = list(rows)
    if baseline not in {r["name"] for r in rows}:
        return f"no results of the baseline {baseline}; there are {', '.join(r['name'] for r in rows) or 'none'}"

    def accuracy(r: dict) -> str:
        text, pair = f"{THREE.value(r['accuracy'])} ± {THREE.value(r.get('stderr'))}", (paired or {}).get(r["name"])
        if r["name"] == baseline or not pair or pair.get("mean") is None:
            return text
        return f"{text} ({THREE.less(pair['mean'], 0.0)} ± {THREE.value(pair['stderr'])})"

    columns = {
        "pipeline": lambda r: r["name"],
        "right": accuracy,
        "contains": lambda r: THREE.value(r["contains"]),
        "evidence in prompt": lambda r: THREE.value(r["evidence_rate"]),
        "unparsed": lambda r: r["unparsed"],
        "errors": lambda r: r["errors"],
        "answers": lambda r: r["scored"],
    }
    return Table(columns, rows).markdown()


def report(sections: dict[str, str]) -> str:
    """Sections with a title each; empty ones are left out."""
    return "\n\n".join(f"## {title}\n\n{body}" for title, body in sections.items() if body)
