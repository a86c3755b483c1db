"""What services are asked, in our own words; a run saves the id of the wording that it used."""

from __future__ import annotations

import hashlib

from pairloom.schema import PROBABILITY

RELEVANT = {
    "type": PROBABILITY,
    "instructions": "Could someone who reads only the passage at {path} settle the query, or a part of it?",
    "criteria": {
        "true": "Something that settles the query or a part of it can be quoted from the passage.",
        "false": "Nothing in it can be quoted for that, whatever its subject or wording.",
    },
}
RELEVANT_PLAIN = {"type": PROBABILITY, "instructions": "Is the passage at {path} relevant to the query?", "criteria": {}}
GRADE = {
    "type": "score",
    "instructions": "What could be quoted from the passage at {path} to settle the query?",
    "criteria": ["nothing", "a hint where to look", "one of several parts", "all of it"],
}
BETTER = {
    "type": "choice",
    "instructions": "Which of the passages at {left} and {right} helps more to answer the query?",
    "criteria": {"a": "The one at {left}.", "b": "The one at {right}."},
}
ANSWER = (
    "You fill in one field of a form. The field's question and some numbered passages follow. Write what belongs in the "
    "field between <answer> and </answer>: a name, number, date or short phrase that a passage states, without a sentence "
    "around it. Write <answer>unknown</answer> when no passage states it."
)


def wording_id(text: str) -> str:
    """A short id of a wording: the start of its SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()[:16]
