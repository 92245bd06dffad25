"""A small inventory, template and client of our own, for queries and tests on the driver's tables."""

from __future__ import annotations

import hashlib
import json

FAMILIES = [
    "Southern American English", "Midwestern/North Central", "Northeastern/New England", "Western American English", "Appalachian English", "African American English (AAE)",
]
# id, category, name, further markers, description, context to avoid; ids and names of some imply markers or stand for a pattern
_FEATURES = [
    [("s_yall", "lexical", "y'all", ["you all"], "plural you", ""), ("s_reckon", "lexical", "I reckon", [], "", ""), ("s_fixing", "syntactic", "fixing to", ["fixin to"], "", "formal letters"), ("s_double_modal", "syntactic", "double modal", [], "two modals", ""), ("s_yonder", "lexical", "yonder", [], "", "")],
    [("m_ope", "discourse", "ope", [], "", ""), ("m_guys", "lexical", "you guys", [], "", ""), ("m_come", "syntactic", "come with", [], "", ""), ("midwestern_alls", "syntactic", "alls construction", [], "", ""), ("m_sure", "discourse", "for sure", [], "", ""), ("m_needs_cleaned", "syntactic", "needs cleaned", [], "", "")],
    [("n_wicked", "lexical", "wicked", [], "", ""), ("n_so", "syntactic", "so don't I", [], "", ""), ("n_left", "lexical", "bang a left", [], "", ""), ("n_cellar", "lexical", "down cellar", [], "", "")],
    [("w_hella", "lexical", "hella", [], "", ""), ("w_totally", "discourse", "totally", [], "", ""), ("w_like", "discourse", "like", [], "", ""), ("w_sure", "discourse", "for sure", [], "", "")],
    [("p_youuns", "lexical", "you'uns", ["yinz"], "", ""), ("p_a_prefixing", "syntactic", "a-prefixing", [], "", ""), ("p_kin", "lexical", "kinfolk", [], "", ""), ("p_tag_right", "discourse", "tag question right", [], "", ""), ("p_demonstrative_them", "syntactic", "demonstrative them", [], "", "")],
    [("a_finna", "lexical", "finna", ["tryna"], "", ""), ("a_perfective_done", "syntactic", "perfective done", [], "", ""), ("aae_habitual_be", "syntactic", "habitual be", [], "", ""), ("a_aint", "syntactic", "ain't", [], "", "")],
]
INVENTORY = {
    family: {
        "dialect_family": family, "review_status": ("draft", "approved")[k % 2], "needs_linguist_review": k == 1,
        "features": [
            {"id": i, "category": c, "feature": f, "source_reference": "own", "allowed_for_generation": True, "detection_markers": m} | ({"description": d} if d else {}) | ({"blocked_context": x} if x else {})
            for i, c, f, m, d, x in features
        ] + [{"id": "off", "category": "lexical", "feature": "howdy", "source_reference": "own", "allowed_for_generation": False, "detection_markers": []}],
        "disallowed_features": ["eye dialect", "mock spelling"][: 1 + k % 2], "safety_notes": ["Keep the writer's level.", "No stereotypes."][: k % 3],
    }
    for k, (family, features) in enumerate(zip(FAMILIES, _FEATURES))
}
TEMPLATE = "Question: {PROMPT}\n\nText: {ANCHOR_RESPONSE}\n\nVariety: {DIALECT_FAMILY}\n{FEATURE_INVENTORY}\n{DISALLOWED_FEATURES_AND_NOTES}"
PLAIN_TEMPLATE = "Question: {PROMPT}\n\nText: {ANCHOR_RESPONSE}\n\nVariety: {DIALECT_FAMILY}"


def offline_client():
    """A client that answers from the prompt alone."""

    def answer(prompt: str) -> dict:
        mark = hashlib.sha256(prompt.encode()).hexdigest()[:12]
        return {"id": f"own_{mark}", "text": f"Answer {mark} to {len(prompt)} characters.", "usage": json.dumps({"input_tokens": len(prompt.split()), "output_tokens": 6})}

    return answer
