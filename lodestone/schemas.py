"""Explicit schemas of the tables that are read and written."""

from __future__ import annotations

PASSAGES = (
    "id string, title string, text string, entities array<string>, links array<string>, "
    "sentences array<string>"
)
QUERIES = (
    "id string, question string, answer string, answers array<string>, "
    "supporting_passage_ids array<string>, "
    "supporting_facts array<string>, "
    "evidence_triples array<array<string>>, evidences array<array<string>>, "
    "supporting_paragraph_indices array<int>, "
    "passage_indices array<struct<pid:string,idx:int>>, "
    "question_type string, type string, dataset string"
)
RESULTS = (
    "query_id string, question string, question_type string, dataset string, support_count int, "
    "policy string, slice string, supporting_ids array<string>, retrieved_ids array<string>, "
    "predictions map<string,string>, "
    "reader_evidence map<string,struct<supporting_facts:array<struct<title:string,sent_idx:int>>,"
    "evidence_triples:array<array<string>>>>, metrics map<string,double>"
)
BUNDLES = "query_id string, rows array<struct<policy:string>>, traces array<struct<policy:string>>"
COUNTERFACTUALS = (
    "query_id string, evidence_ids array<string>, candidate_id string, delta_f1 double, "
    "base_f1 double, candidate_f1 double, path_hops int, path_confidence double, max_hubness long"
)
MULTI_HOP = (
    "_id string, question string, answer string, type string, "
    "context array<string>, supporting_facts array<string>, evidences array<array<string>>"
)
# Entries of the two lists come as objects or as [title, sentences] and [title, index] pairs.
CONTEXT_ENTRY = "title string, sentences array<string>"
FACT_ENTRY = "title string, sent_idx int, idx int"
PARAGRAPHS = (
    "id string, question string, answer string, answer_aliases array<string>, answerable boolean, "
    "paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
)
