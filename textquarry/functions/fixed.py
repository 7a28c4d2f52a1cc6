"""Word lists, dictionaries, patterns and bounds that results depend on, stated as they are."""

from __future__ import annotations

# Stop words by operator family.
_COMMON = "a an the and or but in on at to for of with by from is was are were be been being have has had do does did will would could should may might shall that this it its as not no"
RERANK_STOPS = _COMMON.split()
DEDUP_STOPS = f"{_COMMON} i we he she they what which who".split()
EXPANSION_STOPS = f"{_COMMON} i we he she they what which who how when where why about between into through".split()
VARIANT_STOPS = f"{_COMMON} what which who how when where why about between into through".split()
COMPRESSION_STOPS = (
    "a an the and or but in on at to for of with by from is was are were be been being have has had do does did will would could should may might shall can this that these those it its not no nor so yet both "
    "either neither each any all some such which who whom whose what when where how there their they he she we i you me him her us my your his our than then"
).split()

# Abbreviations that do not end a sentence.
CHUNK_ABBREVIATIONS = "Mr. Mrs. Ms. Dr. Prof. Jr. Sr. Inc. Ltd. Corp. Co. No. Art. Sec. Vol. Ch. Cl. Para. Sched. Pt. vs. v.".split()
COMPRESSION_ABBREVIATIONS = [*CHUNK_ABBREVIATIONS, "cf.", "e.g.", "i.e."]

# Synonyms, in the order in which they are offered.
SYNONYMS = {
    "agreement": ["contract", "covenant", "deed", "pact", "arrangement"],
    "contract": ["agreement", "covenant", "deed", "pact"],
    "breach": ["violation", "infringement", "contravention", "default"],
    "violation": ["breach", "infringement", "contravention", "transgression"],
    "remedy": ["relief", "redress", "compensation", "cure", "restitution"],
    "damages": ["compensation", "restitution", "indemnity", "reparation"],
    "liability": ["obligation", "responsibility", "accountability", "culpability"],
    "negligence": ["carelessness", "recklessness", "fault", "dereliction"],
    "duty": ["obligation", "responsibility", "burden"],
    "obligation": ["duty", "responsibility", "commitment", "undertaking"],
    "jurisdiction": ["authority", "competence", "venue"],
    "statute": ["legislation", "act", "law", "enactment", "ordinance"],
    "legislation": ["statute", "act", "law", "code", "regulation"],
    "regulation": ["rule", "statute", "directive", "ordinance", "provision"],
    "appeal": ["review", "challenge", "application", "petition"],
    "judgment": ["decision", "ruling", "verdict", "order", "decree"],
    "ruling": ["judgment", "decision", "verdict", "determination", "finding"],
    "injunction": ["restraining order", "order", "prohibition", "interdict"],
    "plaintiff": ["claimant", "complainant", "petitioner", "applicant"],
    "defendant": ["respondent", "accused", "accused party"],
    "evidence": ["proof", "testimony", "documentation", "exhibit"],
    "testimony": ["evidence", "statement", "deposition", "affidavit"],
    "precedent": ["authority", "case law", "ruling", "decision"],
    "tort": ["wrong", "civil wrong", "delict"],
    "fraud": ["deception", "misrepresentation", "deceit", "dishonesty"],
    "consent": ["agreement", "approval", "assent", "acquiescence"],
    "search": ["retrieve", "find", "query", "look up", "locate"],
    "retrieve": ["fetch", "extract", "obtain", "pull"],
    "query": ["search", "request", "inquiry", "question"],
    "document": ["record", "file", "text", "paper", "report"],
    "result": ["outcome", "finding", "match", "hit"],
    "index": ["catalogue", "inventory", "register", "database"],
    "rank": ["order", "sort", "prioritise", "score"],
    "relevance": ["pertinence", "applicability", "appropriateness"],
    "embedding": ["vector", "representation", "encoding", "feature"],
    "vector": ["embedding", "representation", "array"],
    "similarity": ["resemblance", "likeness", "closeness", "proximity"],
    "classification": ["categorisation", "labelling", "tagging"],
    "summarise": ["summarize", "condense", "abstract", "distil"],
    "summarize": ["summarise", "condense", "abstract", "distil"],
    "extract": ["retrieve", "obtain", "pull", "derive"],
    "analyse": ["analyze", "examine", "assess", "evaluate", "review"],
    "analyze": ["analyse", "examine", "assess", "evaluate", "review"],
    "accuracy": ["precision", "correctness", "fidelity", "exactness"],
    "performance": ["efficiency", "effectiveness", "speed", "throughput"],
    "model": ["algorithm", "system", "architecture", "network"],
    "training": ["learning", "fitting", "optimisation"],
    "inference": ["prediction", "scoring", "evaluation"],
    "improve": ["enhance", "optimise", "optimize", "refine", "boost"],
    "optimise": ["improve", "enhance", "refine", "tune"],
    "optimize": ["improve", "enhance", "refine", "tune"],
    "error": ["fault", "mistake", "defect", "bug", "issue"],
    "issue": ["problem", "error", "concern", "matter"],
    "problem": ["issue", "challenge", "difficulty", "obstacle"],
    "solution": ["resolution", "answer", "approach", "fix"],
    "method": ["approach", "technique", "procedure", "strategy"],
    "process": ["procedure", "workflow", "operation", "pipeline"],
    "data": ["information", "records", "content", "dataset"],
    "information": ["data", "knowledge", "content", "details"],
    "report": ["document", "analysis", "summary", "finding"],
    "review": ["assessment", "evaluation", "examination", "audit"],
    "update": ["modify", "amend", "revise", "change"],
    "remove": ["delete", "eliminate", "drop", "exclude"],
    "add": ["include", "insert", "append", "incorporate"],
}

# Acronyms and what they stand for.
ACRONYMS = {
    "nlp": "natural language processing",
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "llm": "large language model",
    "rag": "retrieval augmented generation",
    "bert": "bidirectional encoder representations transformers",
    "gpt": "generative pre-trained transformer",
    "tfidf": "term frequency inverse document frequency",
    "tf-idf": "term frequency inverse document frequency",
    "bm25": "best match 25",
    "ndcg": "normalised discounted cumulative gain",
    "mrr": "mean reciprocal rank",
    "map": "mean average precision",
    "rrf": "reciprocal rank fusion",
    "mmr": "maximal marginal relevance",
    "ner": "named entity recognition",
    "pos": "part of speech",
    "ocr": "optical character recognition",
    "api": "application programming interface",
    "sdk": "software development kit",
    "cli": "command line interface",
    "ui": "user interface",
    "ux": "user experience",
    "ci": "continuous integration",
    "cd": "continuous deployment",
    "sql": "structured query language",
    "nosql": "non relational database",
    "ip": "intellectual property",
    "ipc": "intellectual property code",
    "nda": "non disclosure agreement",
    "tos": "terms of service",
    "gdpr": "general data protection regulation",
    "adr": "alternative dispute resolution",
    "mou": "memorandum of understanding",
    "sla": "service level agreement",
    "ipo": "initial public offering",
    "m&a": "mergers and acquisitions",
    "aml": "anti money laundering",
    "kyc": "know your customer",
}

# Histogram bounds.
LATENCY_MS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
RESULT_COUNT = [0, 1, 5, 10, 25, 50, 100]
DOC_SIZE = [256, 1024, 4096, 16384, 65536, 262144, 1048576]

# Fixed value: what starts a section of a structured document.
SECTION = r"(?:^|\n)(?:#{1,4}\s+.+|(?:\d+\.)+\s+[A-Z]|\([a-z]\)\s+|\([ivxlcdm]+\)\s+|[A-Z][A-Z\s]{5,}|---+)"

# Separators of the recursive chunker, coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]

# Fixed value: the hypothetical passage of a query in a domain.
HYPOTHESIS = (
    "In the context of %1$s, %2$s refers to a situation where the relevant principles and regulations apply. The key aspects include the interpretation of %2$s under established %1$s frameworks, "
    "the applicable standards, and the procedural requirements that govern such matters."
)

# Cut-offs of the evaluation, and the rank constant of reciprocal rank fusion.
CUTOFFS = [1, 3, 5, 10]
RRF_K = 60
