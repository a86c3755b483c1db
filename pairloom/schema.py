"""Schemas of the tables that operators take and give; sources never infer them."""

from __future__ import annotations

#: The services' name of an answer that is a probability: its type, and the field that holds it (a fixed value).
PROBABILITY = "noul"
#: Scored pairs: ``ordinal`` is the input order, which breaks ties everywhere.
PAIRS = "dataset string, route string, query_id string, doc_id string, ordinal long, label int, score double"
CANDIDATES = "query_id string, ordinal long, doc_id string, title string, text string, label int"
QUERIES = "query_id string, question string, answers array<string>, category string"
FACTS = "array<struct<id:string,fact:string>>"
SYNTHETIC = f"id string, domain string, question_type string, question string, required_facts {FACTS}, documents array<struct<doc_id:string,role:string,contains_facts:array<string>,near_miss:string,text:string>>, reference_answer string, _corrupt_record string"
VIEWS = f"id string, question string, required_facts {FACTS}, documents array<struct<doc_id:string,text:string>>"
VERDICTS = "id string, verdicts array<struct<doc_id:string,facts_stated:array<string>,leak_phrase:boolean,note:string>>, question_checks struct<needs_multiple_docs:boolean,non_factoid:boolean,answerable_from_facts:boolean,note:string>, _corrupt_record string"
FLAT = "q_id string, question string, answers array<string>, passage_row_id string, title string, text string, label int"
JSONL = "question string, answer string, positive array<string>, negative array<string>"
QRELS = "q string, iter string, docid string, rel int"
TOPICS = "q string, text string"
CORPUS = "docid string, title string, text string"
#: Answers of a scorer: one of the value columns is set, by ``type``.
ANSWERS = f"question_id string, type string, {PROBABILITY} double, choice string, score double, probabilities map<string,double>"
