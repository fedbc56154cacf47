"""Word lists, patterns and tag maps the scores are defined by."""

# Severity weight of risk words; the first entry contained in a token counts.
RISK_SEVERITY = {
    "severe": 3, "critical": 3, "material": 2, "significant": 2,
    "adverse": 2, "substantial": 2, "cyber": 3, "breach": 3,
    "compliance": 2, "violation": 3, "litigation": 2, "regulatory": 2,
    "sanction": 3, "investigation": 2, "penalty": 3, "suspension": 3,
    "default": 3, "bankruptcy": 4, "insolvency": 4, "going concern": 5,
    "restructuring": 2, "impairment": 2, "write-down": 2,
    "supply chain disruption": 2, "shortage": 2, "tariff": 2,
    "geopolitical": 2, "conflict": 2,
}

# Evasive phrases, matched in this order.
EVASIVE_PATTERNS = [
    r"not going to comment",
    r"can't disclose",
    r"no comment",
    r"decline to answer",
    r"don't have visibility",
    r"too early to say",
    r"difficult to predict",
    r"uncertain",
    r"not providing guidance",
    r"won't speculate",
    r"competitive reasons",
    r"we'll see how it plays out",
    r"hard to quantify",
]

# Skill patterns by category.
SKILL_PATTERNS = {
    "ai_ml": [
        r"machine learning", r"deep learning", r"artificial intelligence",
        r"\bAI\b", r"neural network", r"transformer", r"LLM", r"large language model",
        r"PyTorch", r"TensorFlow", r"JAX",
    ],
    "gpu_hpc": [
        r"\bGPU\b", r"\bCUDA\b", r"\bHPC\b", r"high performance computing",
        r"parallel computing", r"accelerator", r"\bFPGA\b",
    ],
    "defense_systems": [
        r"missile", r"radar", r"weapon", r"\bC4ISR\b", r"\bISR\b",
        r"electronic warfare", r"aerospace", r"avionics", r"\bDoD\b",
        r"defense", r"munitions", r"ordnance",
    ],
    "cyber": [
        r"cyber\w*", r"infosec", r"information security",
        r"penetration test", r"vulnerability", r"\bCISSP\b",
        r"zero trust", r"\bSOC\b", r"\bSIEM\b",
    ],
    "software_engineering": [
        r"\bC\+\+\b", r"\bRust\b", r"\bPython\b", r"\bJava\b",
        r"software engineer", r"\bDevOps\b", r"\bCI/CD\b",
        r"microservices", r"\bAPI\b", r"\bbackend\b",
    ],
    "data_infra": [
        r"data engineer", r"data pipeline", r"\bETL\b",
        r"\bSQL\b", r"\bDuckDB\b", r"\bPostgreSQL\b",
        r"\bKafka\b", r"\bSpark\b", r"data lake",
    ],
    "embedded": [
        r"embedded", r"firmware", r"\bRTOS\b", r"microcontroller",
        r"\bVHDL\b", r"\bVerilog\b", r"\bARM\b", r"\bRISC-V\b",
    ],
    "cloud": [
        r"\bAWS\b", r"\bAzure\b", r"\bGCP\b", r"cloud",
        r"\bKubernetes\b", r"\bk8s\b", r"\bDocker\b", r"container",
    ],
    "clearance": [
        r"security clearance", r"top secret", r"\bTS/SCI\b",
        r"secret clearance", r"\bSCI\b", r"polygraph",
        r"\bSAP\b", r"special access",
    ],
}

# Categories of the hiring composite.
HIRING_CATEGORIES = ["ai_ml", "gpu_hpc", "cyber", "data_infra", "clearance"]

# Report label of each company-facts tag.
XBRL_TAGS = {
    "Revenue": "Revenues",
    "NetIncome": "NetIncomeLoss",
    "EPS_Basic": "EarningsPerShareBasic",
    "EPS_Diluted": "EarningsPerShareDiluted",
    "TotalAssets": "Assets",
    "TotalLiabilities": "Liabilities",
    "TotalEquity": "StockholdersEquity",
}

# Revenue tags in order of preference.
REVENUE_TAGS = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "SalesRevenueNet",
]

# Words that tell the columns of OTC files, by standard name; the first that fits decides.
OTC_WORDS = {
    "trade_date": [["tradedate"]], "share_volume": [["share", "quantity"]], "trade_count": [["trade", "count"]],
    "ticker": [["symbol"], ["ticker"], ["issue"]], "issue_name": [["name"]], "tier": [["tier"]],
    "market_makers": [["market", "maker"]], "avg_price": [["price"], ["sale"]],
}
