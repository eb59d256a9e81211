"""The registered queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations


def registry() -> dict:
    from tallyfold.plans import contexts, evidence, identity, mechanisms, naming, registers, retrieval, tables, texts, turns

    out: dict = {}
    for module in (registers, tables, texts, turns, identity, retrieval, naming, evidence, mechanisms, contexts):
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = pair
    return out
