"""Importing this module registers every query of the subpackage."""

from fiscora.llm import decontaminate, hmm, infill, langid, pieces, pii, quality, ranking, secrets, simhash, substrings, toxicity, urls  # noqa: F401
from fiscora.llm.registry import ORACLES, QUERIES  # noqa: F401
