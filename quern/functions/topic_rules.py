"""The rule table of topic families: own phrases, as rows. A family is asked for by a question's phrases; context in a text speaks for it, conflict against it,
and an intent of the question adds to a text with any context. Phrases are in plain form (lower case, one blank between words), and none overlaps itself."""

from __future__ import annotations

#: Of each family: the most that context adds and conflict takes.
CAPS = {
    "amount": (40, 30), "topic": (80, 110), "kind": (26, 12), "closing_first": (60, 60), "quantifier": (30, 20), "clause": (34, 28), "duty": (32, 16), "anchor": (44, 22), "order": (40, 24),
    "holding": (36, 18), "procedure": (28, 14), "closing": (47, 40), "fee": (44, 30), "tax": (40, 30), "compensation": (60, 45), "dissolution": (84, 70), "liquidation": (72, 60), "formation": (44, 36),
}

_FAMILIES = {
    # family: (asked by, context, conflict, intents), each {phrase: points}
    "amount": (["how much is", "amount", "that the", "montant"], {"percent": 12, "total of": 10, "with the": 6, "eur": 8}, {"without charge": 15, "for the": 4}, {"how much is": 8}),
    "topic": (["about", "of the", "über", "sobre"], {"of the": 20, "in the": 14, "and of": 9, "of that": 11}, {"by the": 25, "of the and": 30, "not of": 18}, {"what is": 10}),
    "kind": (["kind", "type of", "which", "welche"], {"kinds of": 18, "the following": 9, "and the": 5}, {"only one": 12}, {"which": 6}),
    "closing_first": (["closing", "ends", "to the"], {"closing of": 30, "end of": 20, "to the": 8, "to an": 7}, {"opening": 25, "at the": 9}, {"when": 10}),
    "quantifier": (["how many", "number of", "cuántos", "is the"], {"number of": 16, "at least": 9, "is that": 6, "is the": 7}, {"unlimited": 14, "as the": 3}, {"how many": 9}),
    "clause": (["clause", "section", "article", "in the"], {"clause": 34, "section": 20, "in the": 4, "in that": 6}, {"annex": 28, "on the": 5}, {"which clause": 8}),
    "duty": (["duty", "must", "shall", "as the"], {"must": 16, "is obliged to": 20, "as that": 5, "as the": 4}, {"may": 10, "or the": 3}, {"who": 5}),
    "anchor": (["the of", "and the", "de la"], {"and the": 9, "and that": 11, "de la": 7, "de los": 6}, {"but the": 8, "and": 1}, {"why": 4}),
    "order": (["order", "with the", "liste"], {"order of": 24, "with that": 9, "with the": 6}, {"cancelled": 24, "from the": 4}, {"who ordered": 9}),
    "holding": (["share", "holder", "was the"], {"shares of": 18, "was that": 6, "was the": 7}, {"loan": 18, "are the": 4}, {"how many shares": 12}),
    "procedure": (["how to", "steps to", "by the", "comment"], {"first": 7, "then": 6, "by the": 5, "by that": 6}, {"exempt": 14, "an the": 2}, {"how to": 9}),
    "closing": (["close", "on the", "schließen"], {"closed": 15, "on that": 8, "on the": 6}, {"opened": 20, "it the": 3}, {"how to close": 10}),
    "fee": (["fee", "charge", "for the", "gebühr"], {"a fee of": 24, "for that": 8, "for the": 7}, {"free of charge": 30, "free": 6}, {"how much is": 7}),
    "tax": (["tax", "duty on", "from the", "steuer"], {"tax of": 22, "from that": 8, "from the": 6}, {"tax free": 30, "tax": 3}, {"how much tax": 12}),
    "compensation": (["compensation", "pay", "are the"], {"compensation for": 35, "are that": 9, "are the": 8}, {"waived": 45, "be the": 4}, {"who pays": 10}),
    "dissolution": (["dissolution", "dissolve", "at the"], {"dissolution": 44, "at an": 12, "at the": 8}, {"founding": 40, "have the": 6}, {"when": 9}),
    "liquidation": (["liquidation", "liquidator", "or the"], {"liquidator": 36, "or that": 10, "or the": 7}, {"solvent": 40, "has the": 5}, {"who": 7}),
    "formation": (["formation", "found", "this the", "die gründung"], {"founders": 22, "this an": 8, "this the": 9}, {"was dissolved": 36, "had the": 4}, {"how to found": 8}),
}

#: (family, kind, phrase, points), in the order of the families.
ROWS = [
    row
    for family, (asked, context, conflict, intents) in _FAMILIES.items()
    for row in [
        *((family, "ask", p, 0) for p in asked),
        *((family, "context", p, n) for p, n in context.items()),
        *((family, "conflict", p, n) for p, n in conflict.items()),
        *((family, "intent", p, n) for p, n in intents.items()),
    ]
]
SCHEMA = "rule_id long, family string, kind string, phrase string, points int, cap_up int, cap_down int"
NUMBERED = [(k, f, kind, p, n, *CAPS[f]) for k, (f, kind, p, n) in enumerate(ROWS)]
