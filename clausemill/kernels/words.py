"""Word lists and fixed patterns of the contract domain."""

from __future__ import annotations

# English function words (the usual public list of 179, contractions included).
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but if
    or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don don't should should've
    now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
    weren't won won't wouldn wouldn't""".split()
)
# Words that carry legal meaning and must survive, and archaic words that carry none.
PROTECTED_WORDS = frozenset(
    """not no nor never without unless except neither none cannot n't shall may must will should can any all only
    before after during within until against""".split()
)
ARCHAIC_WORDS = frozenset("hereby herein hereto hereof thereof therein whereas witnesseth hereinafter aforesaid".split())
CUSTOM_STOP_WORDS = (STOP_WORDS - PROTECTED_WORDS) | ARCHAIC_WORDS
FUNCTION_WORDS = STOP_WORDS | ARCHAIC_WORDS

# First halves of compounds that keep their hyphen over a line break.
KEPT_PREFIXES = frozenset("non self co ex anti work part full year long short third cross on off in out pre post sub inter multi".split())

# Abbreviations after which a line or sentence goes on.
LINE_ABBREVIATIONS = ("Pvt", "Ltd", "Co", "Inc", "No", "Rs", "Sr", "Jr", "Dr", "Mr", "Mrs", "Ms", "viz", "Govt", "Dept")

# Modal verbs, and the words that show that a negation was kept.
MODALS = frozenset("shall may must will should can".split())
NEGATIONS = ("not", "without", "never")

# The probes of pipeline quality.
DOMAIN_PROBES = (
    "employee", "employer", "employment", "confidential", "confidence", "terminal", "termination", "non-compete",
    "non-solicitation", "shall not", "without notice", "₹12,00,000", "Section 27", "notice period",
)
NEGATION_PROBES = ("The Employee shall not disclose.", "The Employer may terminate without notice.", "The Employee must never solicit clients.")
DOMAIN_WORDS = (
    "non-compete", "non-solicitation", "confidentiality", "remuneration", "probation", "termination", "indemnify",
    "stipend", "gratuity", "work-from-home", "hereinafter", "jurisdiction",
)
# Word groups that stemming should keep apart, and that it should unite.
APART = (
    ("employee", "employer", "employment"), ("confidential", "confidence"), ("terminal", "termination"),
    ("provision", "provide"), ("policy", "police"), ("general", "generate"), ("organ", "organization"),
)
TOGETHER = (
    ("compensate", "compensation"), ("resign", "resignation"), ("solicit", "solicitation"), ("indemnify", "indemnity"),
    ("renew", "renewal"), ("absorb", "absorption"), ("terminate", "termination"),
)
# Tags that domain words always have, and words whose tag depends on the word before.
DOMAIN_TAGS = {
    w: "NN"
    for w in """employee employer company intern consultant contractor freelancer worker candidate agreement ctc stipend
    non-compete non-solicitation gratuity annum""".split()
} | {"w.e.f.": "IN"}
NOUN_OR_VERB = frozenset("notice bond sign release claim breach service".split())
