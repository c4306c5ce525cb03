"""The words by which queries are told apart. They must equal the lists that
existing queries were classified by, the garbled ones included, and are in their order."""

OUT_OF_SCOPE = (
    "weather", "weather forecast", "stock price", "stock market", "stocks", "share price", "bitcoin", "cryptocurrency", "sports score", "sports", "recipe",
    "restaurant", "travel", "movie", "music", "joke", "poem", "hello", "hi", "hey", "thanks", "thank you", "how are you", "what's up",
    "浣犲ソ", "璋㈣阿", "闂茶亰", "澶╂皵", "鑲＄エ", "浣撹偛", "鏃呮父",
)

POLICY = (
    "policy", "policies", "guideline", "guidelines", "protocol", "standard of care", "regulation", "regulatory", "compliance", "consent policy",
    "hospital policy", "drug label", "formulary", "sop",
    "鏀跨瓥", "鎸囧崡", "瑙勮寖", "瑙勭▼", "鍚堣", "鑽搧璇存槑涔",
)

CLINICAL = (
    "symptom", "symptoms", "patient", "patients", "case report", "clinical", "diagnosis", "diagnostic", "treatment", "therapy", "medication", "medicine",
    "drug", "dose", "dosage", "side effect", "adverse effect", "contraindication", "prescribe", "disease", "condition", "pain", "fever", "cough",
    "blood pressure", "lab result",
    "鐥呬緥", "鐥囩姸", "鎮ｈ€", "璇婃柇", "娌荤枟", "鑽墿", "鑽",
    "鍓傞噺", "鍓綔鐢", "鐤剧梾",
)

#: Word beginnings that are clinical wherever they stand.
CLINICAL_STEMS = ("diagnos", "璇婄枟")

STRUCTURED = (
    "sql", "database", "table", "column", "row", "count", "sum", "average", "avg", "mean", "median", "percentile", "group by", "aggregate", "aggregation",
    "distribution", "cohort", "queue", "backlog", "how many", "number of",
    "缁熻", "鑱氬悎", "闃熷垪", "鍒嗙粍", "鏁伴噺", "鎬绘暟", "鍒嗗竷",
    "姣斾緥", "鍧囧€", "骞冲潎",
)

#: Parts of a question that ask for an aggregate.
AGGREGATION = (
    "count", "sum", "average", "avg", "mean", "median", "percentile", "group by", "aggregate", "aggregation", "distribution", "cohort", "how many", "number of",
    "缁熻", "鑱氬悎", "鍒嗗竷", "姣斾緥", "鍧囧€", "骞冲潎", "鎬绘暟",
)
