"""A service played in the process."""

from __future__ import annotations

from typing import Any

from pairloom.schema import PROBABILITY


class ByNumber:
    """Answers each question from the number that its id ends in; refuses or breaks where told.

    A probability: number % 101 / 100. choice: the first option for an even number. score: number % the
    number of levels. ``refused``: a text in a question's id that gives status 400; ``broken``:
    how many of the first requests give status 503.
    """

    def __init__(self, refused: str = "\0", broken: int = 0) -> None:
        self.refused, self.broken, self.asked = refused, broken, 0

    def __call__(self, body: dict[str, Any]) -> tuple[int, Any]:
        self.asked += 1
        if self.asked <= self.broken:
            return 503, "busy"
        questions = body.get("questions", {})
        if any(self.refused in k for k in questions):
            return 400, {"detail": "refused"}
        return 200, {"answers": {k: self._answer(k, q) for k, q in questions.items()}}

    def _answer(self, key: str, question: dict[str, Any]) -> dict[str, Any]:
        number = int("".join(c if c.isdigit() else " " for c in key).split()[-1])
        levels = list(question.get("criteria") or ["a", "b"])
        if question["type"] == PROBABILITY:
            return {"type": PROBABILITY, PROBABILITY: number % 101 / 100}
        if question["type"] == "score":
            return {"type": "score", "score": float(number % len(levels))}
        won = levels[number % 2]
        return {"type": "choice", "choice": won, "probabilities": {x: 0.9 if x == won else 0.1 / max(1, len(levels) - 1) for x in levels}}
