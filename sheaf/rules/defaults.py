"""Default rule set: wording, keyword lists and patterns.

Everything in this module is data.  Operators take these tables as
arguments, so a caller can pass its own vocabulary; the defaults below
reproduce the behaviour of the question-answering project this library
re-expresses.

Fixed values: the strings, keyword lists, orders and regex patterns
below must equal the original project's for identical results.  Order is
semantic everywhere (first match wins, passes see each other's output).
Regex patterns are written in Python ``re`` syntax and translated by
``sheaf.rules.dialect``.
"""

# --------------------------------------------------------------------------
# Null model
# --------------------------------------------------------------------------
NOT_AVAILABLE = "Not available"

#: Name that the assistant goes by in all wording below.
ASSISTANT_NAME = "GrainGuide"


def named(text: str, name: str = ASSISTANT_NAME) -> str:
    """``text`` with the assistant's name at its ``{assistant}`` places; other placeholders stay."""
    return text.replace("{assistant}", name)

# Entity columns, (CSV header, column name) in natural order.
ENTITY_COLUMNS = [
    ("Millet ID", "millet_id"),
    ("Millet Name", "millet_name"),
    ("Source Url", "source_url"),
    ("Nutritional Profile", "nutritional_profile"),
    ("Health Benefits", "health_benefits"),
    ("Cultivation Information", "cultivation_information"),
    ("drought_tolerance", "drought_tolerance"),
    ("heat_tolerance", "heat_tolerance"),
    ("irrigation_requirement", "irrigation_requirement"),
    ("irrigation_method", "irrigation_method"),
    ("storage_duration_months", "storage_duration_months"),
    ("soil_texture_preference", "soil_texture_preference"),
    ("soil_organic_matter_percent_min", "soil_organic_matter_percent_min"),
    ("soil_salinity_tolerance_ec", "soil_salinity_tolerance_ec"),
    ("soil_depth_cm_min", "soil_depth_cm_min"),
    ("common_pests", "common_pests"),
    ("pest_control_ipm", "pest_control_ipm"),
    ("common_diseases", "common_diseases"),
    ("disease_control_methods", "disease_control_methods"),
    ("crop_rotation_benefits", "crop_rotation_benefits"),
    ("companion_crops_recommended", "companion_crops_recommended"),
    ("weed_management_critical_period_das", "weed_management_critical_period_das"),
    ("mechanization_level", "mechanization_level"),
    ("labor_requirement_person_days_ha", "labor_requirement_person_days_ha"),
    ("market_price_retail_inr_per_kg", "market_price_retail_inr_per_kg"),
    ("value_addition_potential", "value_addition_potential"),
    ("market_demand", "market_demand"),
    ("Market Data (Approx. INR/kg)", "market_data_inr_per_kg"),
    ("biofortification_potential", "biofortification_potential"),
    ("genome_sequencing_status", "genome_sequencing_status"),
    ("climate_change_adaptation_score", "climate_change_adaptation_score"),
    ("research_priority_score", "research_priority_score"),
    ("Recipes", "recipes"),
    ("Millet Scientific Name", "millet_scientific_name"),
    ("Millet Description", "millet_description"),
    ("origin_region", "origin_region"),
    ("cultivation_history_years", "cultivation_history_years"),
    ("gluten_free", "gluten_free"),
]

# --------------------------------------------------------------------------
# Instruction templates, per category, in output order.
# Each entry is (instruction, input, output); ``{column}`` is replaced by
# the entity value after null handling.  ``{gf_word}`` / ``{gf_suit}`` are
# the two conditional fragments of the gluten question.
# --------------------------------------------------------------------------
CATEGORY_TEMPLATES = [
    ("nutrition", [
        ("What are the nutritional benefits of {millet_name}?", "", "{nutritional_profile}"),
        ("Provide a detailed nutritional breakdown for {millet_name}.", "",
         "{nutritional_profile}\n\nHealth Benefits: {health_benefits}"),
        ("Explain the nutritional profile of this millet.", "Millet: {millet_name}", "{nutritional_profile}"),
        ("How does {millet_name} support health and nutrition?", "",
         "Nutritional Profile: {nutritional_profile}\n\nHealth Benefits: {health_benefits}"),
        ("List the key nutrients found in {millet_name}.", "", "{nutritional_profile}"),
        ("What makes {millet_name} nutritionally valuable?", "",
         "{nutritional_profile}\n\nThese nutrients contribute to: {health_benefits}"),
    ]),
    ("cultivation", [
        ("Describe the cultivation requirements for {millet_name}.", "", "{cultivation_information}"),
        ("What are the ideal growing conditions for {millet_name}?", "",
         "{cultivation_information}\n\nClimate Tolerance: Drought tolerance is {drought_tolerance}, "
         "heat tolerance is {heat_tolerance}."),
        ("Explain the irrigation needs for {millet_name}.", "",
         "Irrigation Requirement: {irrigation_requirement}\nRecommended Method: {irrigation_method}"),
        ("What soil conditions does {millet_name} prefer?", "",
         "Preferred Soil Texture: {soil_texture_preference}\nMinimum Organic Matter: "
         "{soil_organic_matter_percent_min}%\nSalinity Tolerance (EC): {soil_salinity_tolerance_ec}\n"
         "Minimum Soil Depth: {soil_depth_cm_min} cm"),
        ("How long can {millet_name} grains be stored?", "",
         "Storage Duration: {storage_duration_months} months under proper conditions."),
        ("Detail the climate resilience of {millet_name}.", "",
         "Drought Tolerance: {drought_tolerance}\nHeat Tolerance: {heat_tolerance}\n\n"
         "This makes it suitable for: {cultivation_information}"),
        ("Provide cultivation guidelines for this millet variety.", "Millet: {millet_name}",
         "{cultivation_information}\n\nSoil Preferences: {soil_texture_preference}\n"
         "Irrigation: {irrigation_requirement} ({irrigation_method})"),
    ]),
    ("pest_disease", [
        ("What are the common pests affecting {millet_name}?", "",
         "Common Pests: {common_pests}\n\nIPM Control Measures: {pest_control_ipm}"),
        ("List the diseases that affect {millet_name} and their management.", "",
         "Common Diseases: {common_diseases}\n\nControl Methods: {disease_control_methods}"),
        ("Describe integrated pest management strategies for {millet_name}.", "",
         "Target Pests: {common_pests}\n\nIPM Strategies: {pest_control_ipm}"),
        ("How can farmers control diseases in {millet_name} crops?", "",
         "Major Diseases: {common_diseases}\n\nRecommended Control: {disease_control_methods}"),
        ("Outline pest and disease challenges for this millet.", "Millet: {millet_name}",
         "Pests: {common_pests}\nPest Control: {pest_control_ipm}\n\nDiseases: {common_diseases}\n"
         "Disease Control: {disease_control_methods}"),
        ("What preventive measures should be taken for {millet_name} cultivation?", "",
         "Pest Prevention: {pest_control_ipm}\n\nDisease Prevention: {disease_control_methods}"),
    ]),
    ("agronomy", [
        ("What are the crop rotation benefits of growing {millet_name}?", "", "{crop_rotation_benefits}"),
        ("Which crops can be grown as companions with {millet_name}?", "",
         "Recommended Companion Crops: {companion_crops_recommended}"),
        ("Describe the weed management strategy for {millet_name}.", "",
         "Critical Weed Management Period: {weed_management_critical_period_das} days after sowing (DAS)\n\n"
         "During this period, keep fields weed-free for optimal yield."),
        ("What is the mechanization level for {millet_name} cultivation?", "",
         "Mechanization Level: {mechanization_level}\nLabor Requirement: "
         "{labor_requirement_person_days_ha} person-days per hectare"),
        ("Explain the agronomic practices for {millet_name}.", "",
         "Rotation Benefits: {crop_rotation_benefits}\n\nCompanion Crops: {companion_crops_recommended}\n\n"
         "Weed Management: Critical period is {weed_management_critical_period_das} DAS"),
        ("Detail intercropping options for this millet.", "Millet: {millet_name}",
         "Recommended Companions: {companion_crops_recommended}\n\nThese provide: {crop_rotation_benefits}"),
    ]),
    ("market", [
        ("What is the current market price of {millet_name}?", "",
         "Retail Price: ₹{market_price_retail_inr_per_kg} per kg\nMarket Range: {market_data_inr_per_kg}"),
        ("Describe the value addition potential for {millet_name}.", "",
         "Value Addition Opportunities: {value_addition_potential}\n\nCurrent Market Demand: {market_demand}"),
        ("What is the market demand for {millet_name}?", "",
         "Market Demand: {market_demand}\nRetail Price: ₹{market_price_retail_inr_per_kg} per kg"),
        ("List potential value-added products from {millet_name}.", "", "{value_addition_potential}"),
        ("Provide market information for this millet.", "Millet: {millet_name}",
         "Price Range: {market_data_inr_per_kg}\nRetail: ₹{market_price_retail_inr_per_kg}/kg\n"
         "Demand: {market_demand}\n\nValue Addition: {value_addition_potential}"),
        ("What economic opportunities exist for {millet_name} farmers?", "",
         "Direct Sale: ₹{market_price_retail_inr_per_kg}/kg ({market_data_inr_per_kg})\n\n"
         "Value Addition Potential: {value_addition_potential}\n\nMarket Status: {market_demand} demand"),
    ]),
    ("biofortification", [
        ("What is the biofortification potential of {millet_name}?", "",
         "Biofortification Potential: {biofortification_potential}\n\n"
         "This indicates opportunities for enhancing nutritional content through breeding."),
        ("Describe the genome sequencing status of {millet_name}.", "",
         "Genome Sequencing: {genome_sequencing_status}\n\nThis enables advanced breeding and genetic research."),
        ("How well is {millet_name} adapted to climate change?", "",
         "Climate Change Adaptation Score: {climate_change_adaptation_score}/10\n\n"
         "This reflects its resilience to changing climate conditions."),
        ("What is the research priority for {millet_name}?", "",
         "Research Priority Score: {research_priority_score}\n\nBiofortification Focus: "
         "{biofortification_potential}\nGenome Status: {genome_sequencing_status}"),
        ("Detail the genomic and breeding potential of this millet.", "Millet: {millet_name}",
         "Genome: {genome_sequencing_status}\nBiofortification: {biofortification_potential}\n"
         "Climate Adaptation: {climate_change_adaptation_score}/10\nResearch Priority: {research_priority_score}"),
    ]),
    # recipes are generated from the parsed Recipes column (RECIPE_* below)
    ("recipe", []),
    ("factsheet", [
        ("Provide a comprehensive overview of {millet_name}.", "",
         "**Scientific Name:** {millet_scientific_name}\n\n**Description:** {millet_description}\n\n"
         "**Origin:** {origin_region}\n**Cultivation History:** {cultivation_history_years} years"),
        ("Is {millet_name} gluten-free?", "",
         "Gluten-Free Status: {gluten_free}\n\n{millet_name} is naturally {gf_word}, making it {gf_suit} "
         "for people with celiac disease."),
        ("What is the scientific name of {millet_name}?", "", "The scientific name is {millet_scientific_name}."),
        ("Create a fact sheet for this millet.", "Millet: {millet_name}",
         "**Common Name:** {millet_name}\n**Scientific Name:** {millet_scientific_name}\n**Origin:** "
         "{origin_region}\n**History:** Cultivated for {cultivation_history_years} years\n**Gluten-Free:** "
         "{gluten_free}\n\n{millet_description}"),
    ]),
]

# The nutrition category is skipped when the profile is missing.
GATED_CATEGORY = ("nutrition", "nutritional_profile")

# Conditional fragments of the gluten question (value 'Yes' exactly).
GLUTEN_YES = "Yes"
GLUTEN_WORDS = ("gluten-free", "not gluten-free")
GLUTEN_SUIT = ("suitable", "unsuitable")

# Recipe templates.  Per recipe two rows, then three
# aggregate rows when at least one recipe parsed.
RECIPE_SPLIT = "|"
RECIPE_PER_ITEM = [
    ("How do I prepare {recipe_name}?", "", "**{recipe_name}**\n\n{recipe_steps}"),
    ("Provide a recipe for {millet_name}.", "", "**{recipe_name}**\n\n{recipe_steps}"),
]
RECIPE_ITEM_JOIN = ("**{recipe_name}**\n{recipe_steps}", "\n\n")
RECIPE_AGGREGATE = [
    ("What are some traditional recipes using {millet_name}?", "", "{all_recipes}"),
    ("Share cooking methods for {millet_name}.", "", "{all_recipes}"),
    ("List recipes for this millet.", "Millet: {millet_name}", "{all_recipes}"),
]

# Comparison templates for an entity and its next two neighbours.
NEIGHBOR_OFFSETS = (1, 2)
COMPARISON_TEMPLATES = [
    ("Compare the nutritional profiles of {name1} and {name2}.", "",
     "**{name1}:** {nutr1}\n\n**{name2}:** {nutr2}"),
    ("Which millet is more drought-tolerant: {name1} or {name2}?", "",
     "**{name1}:** Drought tolerance is {drought1}\n**{name2}:** Drought tolerance is {drought2}\n\n"
     "Based on these ratings, you can determine which is more suitable for water-scarce conditions."),
    ("Compare market prices of {name1} and {name2}.", "",
     "**{name1}:** ₹{price1} per kg\n**{name2}:** ₹{price2} per kg"),
]
COMPARISON_META = ("{id1},{id2}", "{name1} vs {name2}", "{source1}; {source2}")

# --------------------------------------------------------------------------
# augmentation
# --------------------------------------------------------------------------
# Rephrase groups: (lowercase triggers, literal prefixes removed in order,
# variation templates).  The first group replaces its prefixes on the
# original instruction; a quirk in the original overwrote the first removal,
# so "What are the " leaves "the " in place ("Explain the the ...").
REPHRASE_GROUPS = [
    (["what are", "what is"], ["What are ", "What is "],
     ["Tell me about the {base}", "Explain the {base}", "Describe the {base}", "Can you list the {base}?"]),
    (["how do i", "how to"], ["How do I ", "How to "],
     ["What is the method to {base}?", "Guide me on how to {base}", "Steps to {base}", "Process for {base}"]),
    (["give me", "provide"], ["Give me ", "Provide "],
     ["What {base}?", "Tell me {base}", "List {base}"]),
]
# With fix=True the first group removes the article as well.
REPHRASE_GROUP1_FIXED_PREFIXES = ["What are the ", "What is the "]
REPHRASE_KEEP = 3
REPHRASE_TAG = ("augmentation", "rephrased")

FACT_LINE_SPLIT = "\n"
FACT_KEY_STRIP = "- •*#"
FACT_MIN_VALUE_LEN = 4          # value kept when len(value) > 3
FACT_KEEP = 5
QA_SOURCE_ROWS = None           # explicit Q&A pairs from the first so many records; None: from all
QA_KEEP = 2
QA_NAMES = ["Sorghum", "Jowar", "Bajra", "Pearl Millet", "Ragi", "Finger Millet", "Foxtail", "Chena",
            "Proso", "Kodo", "Barnyard", "Little", "Browntop", "Amaranth"]
QA_WITH_NAME = ["What is the {key} for {name}?", "Tell me the {key} of {name}", "{Key} for {name}?"]
QA_WITHOUT_NAME = ["What is the {key}?", "What about the {key}?", "{Key}?"]

NEGATIVE_META = {"category": "negative_example", "purpose": "anti_hallucination"}
NEGATIVE_EXAMPLES = [
    ("What is the cultivation cost of growing tomatoes?",
     "I apologize, but I don't have specific information about tomato cultivation costs in my training data. "
     "I specialize in information about millets (Sorghum, Pearl Millet, Finger Millet, Foxtail Millet, "
     "Proso Millet, Kodo Millet, Barnyard Millet, Little Millet, Browntop Millet, and Amaranth)."),
    ("Tell me about growing wheat in Punjab",
     "I don't have information about wheat cultivation in my training dataset. My knowledge is focused "
     "specifically on millet crops and their cultivation, nutrition, and pest management in India."),
    ("What is the nutritional value of paneer?",
     "I don't have information about paneer (cheese) nutrition. My specialty is millet nutrition. However, "
     "if you're asking about Chena, which is also known as Proso Millet or Barri, I can provide that "
     "information."),
    ("How do I make pizza dough?",
     "I don't have information about pizza dough in my training data. I specialize in millet-based recipes "
     "and preparations. I can help you with millet recipes like ragi mudde, bajra roti, or jowar bhakri if "
     "you're interested."),
]
SHUFFLE_SEED = 42

# --------------------------------------------------------------------------
# Knowledge-base documents
# --------------------------------------------------------------------------
DOC_WITH_INPUT = "Question: {instruction}\nContext: {input}\n\nAnswer: {output}"
DOC_WITHOUT_INPUT = "Question: {instruction}\n\nAnswer: {output}"
DOC_META_DEFAULTS = [("millet_name", "Unknown"), ("millet_id", ""), ("source", named("{assistant} Training Data"))]
DOC_CATEGORIES = [
    ("nutrition", ["nutri", "protein", "vitamin", "calcium", "iron", "health"]),
    ("cultivation", ["cultiv", "grow", "soil", "irrigat", "climate", "season"]),
    ("pest_management", ["pest", "disease", "control", "ipm", "management"]),
    ("market", ["market", "price", "cost", "value", "demand"]),
    ("recipe", ["recipe", "cook", "prepare", "dish"]),
]
DOC_CATEGORY_DEFAULT = "general"
PREVIEW_CHARS = 200
PREVIEW_DEFAULT = "N/A"

# The five probe questions of the knowledge-base smoke test.
PROBE_QUESTIONS = [
    "What is the calcium content in ragi?",
    "How to grow pearl millet in drought conditions?",
    "What pests attack jowar crops?",
    "Give me a recipe for bajra roti",
    "Which millet is best for diabetics?",
]

# --------------------------------------------------------------------------
# Training text
# --------------------------------------------------------------------------
SFT_SYSTEM_PROMPT = named("You are {assistant}, an expert on millets in India.\nRULES:\n"
                     "1. Chena is Proso Millet, NOT cheese\n2. Never make up data\n3. Only discuss millets")
SFT_TEMPLATE = ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
                "<|start_header_id|>user<|end_header_id|>\n\n{instruction}<|eot_id|>"
                "<|start_header_id|>assistant<|end_header_id|>\n\n{output}<|eot_id|>")
LENGTH_LIMITS = [512, 128, 64]

# Preference pairs: (substrings tested on the lowercased instruction, rejected text).
# None as text means "corrupt the numbers of the chosen answer".
PREFERENCE_RULES = [
    (["chena"], "Chena is a type of fresh Indian cheese made from curdled milk. It's used in sweets like rasgulla."),
    (["ph", "soil"], "The optimal soil pH for all millets is 6.0-7.0, which provides ideal growing conditions."),
    (["protein"], None),
    (["compare"], "Both millets have similar nutritional profiles and can be used interchangeably."),
]
NUMBER_CORRUPTIONS = [("12.5", "8.0"), ("11.6", "7.0"), ("10.4", "6.0")]

# --------------------------------------------------------------------------
# routing
# --------------------------------------------------------------------------
COMPLEXITY_TRIGGERS = [
    ("compare", "comparison"), ("difference between", "comparison"), ("vs", "comparison"),
    ("versus", "comparison"), ("better than", "comparison"), ("which is better", "comparison"),
    ("which millet", "comparison"), ("best millet", "comparison"),
    ("diabetes", "health_reasoning"), ("diabetic", "health_reasoning"), ("blood sugar", "health_reasoning"),
    ("weight loss", "health_reasoning"), ("cholesterol", "health_reasoning"), ("heart health", "health_reasoning"),
    ("bone health", "health_reasoning"), ("anemia", "health_reasoning"), ("pregnant", "health_reasoning"),
    ("pregnancy", "health_reasoning"), ("child", "health_reasoning"), ("baby", "health_reasoning"),
    ("elderly", "health_reasoning"), ("disease", "health_reasoning"), ("condition", "health_reasoning"),
    ("should i eat", "health_reasoning"), ("can i eat", "health_reasoning"), ("is it safe", "health_reasoning"),
    ("when to sow", "cultivation_decision"), ("best time to", "cultivation_decision"),
    ("which soil", "cultivation_decision"), ("how much water", "cultivation_decision"),
    ("irrigation", "cultivation_decision"), ("fertilizer", "cultivation_decision"),
    ("which region", "cultivation_decision"), ("yield", "cultivation_decision"),
    ("profit", "cultivation_decision"), ("market", "cultivation_decision"),
    ("and also", "multi_factor"), ("as well as", "multi_factor"), ("both", "multi_factor"),
    ("multiple", "multi_factor"),
]
COMPLEX_STARTERS = ["which", "what is the best", "how do i choose", "should i"]
COMPLEX_STARTER_TYPE = "decision_making"
MODE_THINKING, MODE_FAST = "thinking", "fast"
THINKING_TYPE = "user_selected_thinking"
# Token budget: request cap by mode, then capped by complexity.
TOKEN_CAP_BY_MODE = {"thinking": 1000, "fast": 350}
TOKEN_CAP_DEFAULT = 400
TOKEN_CAP_COMPLEX, TOKEN_CAP_SIMPLE = 600, 350
BASE_MODEL_TYPE = "base"
DEFAULT_MODEL_TYPE, DEFAULT_MODE = "millet", "fast"
TOP_K = 3
SIMILAR_K = 5

RECIPE_QUESTION_KEYWORDS = ["recipe", "cook", "make", "prepare", "how to make", "dish", "food"]
COOKING_KEYWORDS = ["recipe", "cook", "make", "prepare", "dosa", "idli", "roti", "porridge", "khichdi", "upma",
                    "ladoo", "laddu", "halwa", "eat", "food", "dish", "breakfast", "lunch", "dinner", "snack",
                    "bake", "fry"]
NUTRITION_KEYWORDS = ["protein", "fiber", "fibre", "calcium", "iron", "zinc", "magnesium", "nutrition",
                      "nutritional", "nutrient", "calorie", "energy", "vitamin", "glycemic", "carbohydrate",
                      "mineral"]

# Confidence bands (strictly greater than).
CONFIDENCE_BANDS = [(80, "high"), (50, "medium")]
CONFIDENCE_LOW = "low"
CONFIDENCE_CONSTANT = 95
CONFIDENCE_ON_ERROR = 0

# Topic catalogue: (id, title, description, helper text, theme).
TOPICS = [
    ("Cultivation", "Cultivation",
     "Expert guidance on sowing, vegetative growth, flowering, and maturity stages.",
     "Ask about crop growth & yield", "teal"),
    ("Recipe", "Recipe", "Discover nutritious millet-based recipes and meal planning ideas.",
     "Ask for recipes & meal plans", "orange"),
    ("Nutritional Benefits", "Nutritional Benefits",
     "Detailed analysis of protein, fiber, and mineral content in millets.", "Analyze nutritional values", "red"),
    ("Pest Controls", "Pest Controls", "Identify pests and diseases with solutions and control methods.",
     "Identify pests & solutions", "amber"),
    ("Harvesting & Storage", "Harvesting & Storage",
     "Best practices for harvesting timeframes and safe storage techniques.", "Learn storage techniques",
     "yellow"),
    ("Soil & Climate", "Soil & Climate", "Check soil suitability, temperature, and rainfall requirements.",
     "Check climate suitability", "blue"),
    ("General Query", "General Query", named("{assistant} Core Assistant"), "Ask anything...", "gray"),
]
DEFAULT_THEME = "gray"
WELCOME_TEMPLATE = "Hello! I am your **{context}** assistant. How can I help you regarding {context_lower} today?"
ERROR_MESSAGE = named("⚠️ Error connecting to {assistant} Core. Please check your connection.")

# Nutrient radar: (axis, value, full mark).
NUTRIENT_AXES = [("Protein", 120, 150), ("Fiber", 98, 150), ("Iron", 86, 150), ("Calcium", 99, 150),
                 ("Carbs", 85, 150), ("Micro", 65, 150)]

# --------------------------------------------------------------------------
# Prompt assembly
# --------------------------------------------------------------------------
CONTEXT_ITEM = "About {millet_name}:\n{content}"
CONTEXT_JOIN = "\n\n"
CONTEXT_NAME_DEFAULT = "Unknown"
PROMPT_THINKING = named("""You are {assistant}, an expert on Indian millets.

TASK: Answer using ONLY the KNOWLEDGE below. Be precise and helpful.

RULES:
1. Start with the direct answer immediately
2. Include specific numbers (percentages, mg, g per 100g)
3. For recipes: list ingredients and key steps concisely
4. For comparisons: state the winner clearly with reason
5. Keep response focused and informative
6. Use friendly tone with occasional emojis 🌾

KNOWLEDGE:
{context}

QUESTION: {question}

ANSWER:""")
PROMPT_FAST = named("""You are {assistant}, a friendly assistant for Indian millets 🌾

TASK: Give a concise, direct answer using the KNOWLEDGE below.

RULES:
1. Answer in 1-3 sentences when possible
2. Include exact values (7.3g protein, 344mg calcium, etc.)
3. For yes/no questions: start with Yes/No, then brief explanation
4. For recipes: name + key ingredients + basic steps
5. Be friendly and helpful!

KNOWLEDGE:
{context}

QUESTION: {question}

ANSWER:""")

# --------------------------------------------------------------------------
# Response clean-up (first stage), rules as (pattern, replacement, flags).
# Flags use Python letters: i = IGNORECASE, m = MULTILINE, s = DOTALL.
# --------------------------------------------------------------------------
CUTOFF_MARKERS = ["QUESTION:", "\nQ:", "\n\nQ:", "User:", "\nUser", "KNOWLEDGE:", "\nKNOWLEDGE"]

ASTERISK_RULES = [
    (r"\*\*([^*]+)\*\*", r"\1", ""),
    (r"\*([^*\n]+)\*", r"\1", ""),
    (r"^\*+\s*", "", "m"),
    (r"\*+(?=[:!?,.\)])", "", ""),
    (r"(\w)\*+", r"\1", ""),
    (r"\s\*\s", " ", ""),
    (r"\*", "", ""),
]
PREFIX_RULES = [
    (named(r"^{assistant}:?\s*"), "", "i"),
    (r"^Hi!?\s*I\'?m?\s*happy to help!?\s*", "", "i"),
    (r"^\s*[:\-]\s*", "", ""),
]
BULLET_RULES = [
    (r"•\s*", "• ", ""),
    (r"^\s*-\s+", "• ", "m"),
    (r"\s+•\s+", "\n• ", ""),
]
CONTRADICTION_RULES = [
    (r"Recommendation:\s*Choose both!?\s*", "", "i"),
    (r"Let'?s compare:\s*", "\n", ""),
]
TRAINING_ARTIFACTS = [
    r"Please provide your response[!.]?[^\n]*",
    r"Type 'done' when ready[!.]?[^\n]*",
    r"Your turn[!.]?[^\n]*",
    r"I'll assist further if needed[!.]?[^\n]*",
    r"Here's my response:[^\n]*",
    r"Ask away[!.]?",
    r"Let's get started[!.]?",
    r"Let's chat[!.]?",
    r"Please provide your query[!.]?",
    r"Please provide your answer[^\n]*",
    r"Would you like some specific information\?[^\n]*",
    r"```python[^`]*```",
    r"```[^`]*```",
    r"# Ask away!",
    r"# Let's get started!",
    r"\(Note:[^)]*\)",
    r"\(Also,[^)]*\)",
]
TRAINING_ARTIFACT_FLAGS = "is"
TRAILING_PHRASES = [
    r"Happy to help with anything else[!.]?\s*$",
    r"Please let me know if you need any further assistance[!.]?\s*$",
    r"Feel free to ask more[!.]?\s*$",
    r"Let me know if you have more questions[!.]?\s*$",
    r"What else would you like\?\s*$",
    r"Would you like any other recipe\?\s*$",
    r"Would you like any variations\?\s*$",
    r"Let's cook together[!.]?\s*$",
]
TRAILING_FLAGS = "i"
SPACING_RULES = [
    (r"  +", " ", ""),
    (r"\n +", "\n", ""),
    (r"\n{3,}", "\n\n", ""),
]
MARKDOWN_BULLET_RULES = [
    (r"([.!?])\s*•\s*", r"\1\n• ", ""),
    (r"\s+•\s+", "\n• ", ""),
    (r"^•\s*", "- ", "m"),
    (r"\n•\s*", "\n- ", ""),
]
CONCLUSION_STARTERS = [
    "So, if", "So if", "Therefore,", "Need help", "Would you like", "Let me know",
    "I'm here", "Here's your", "Here is your", "Now you can", "High Now",
    "For more details", "For more information", "Let's help", "Let's compare",
    "Let's get cooking", "What do you need", "Hope this helps",
]
# The one starter with its own rewrite.
CONCLUSION_SPECIAL = ("High Now", r"(High)\s+(Now)", r"\1.\n\n\2")
CONCLUSION_GENERIC = (r"(\S)\s+({escaped})", r"\1\n\n\2")
STEP_RULES = [
    (r"(\S)\s+(\d+\.\s+)", r"\1\n\2", ""),
    (r"\s+\+\s+", "\n- ", ""),
]
SECTION_RULES = [
    (r"(?<!\n)(Recipe\s*\d+\s*:)", r"\n\n\1", ""),
    (r"(?<!\n)([A-Z][a-z]+\s+(?:Roti|Upma|Khichdi|Dosa|Idli|Ladoo|Laddu|Halwa|Porridge)\s*:)", r"\n\n\1", ""),
    (r"(?<!\n)(Ingredients?\s*:)", r"\n\1", ""),
    (r"(?<!\n)(Instructions?\s*:)", r"\n\1", ""),
    (r"(?<!\n)(Steps?\s*:)", r"\n\1", ""),
]
FINAL_NEWLINE_RULES = [(r"\n{3,}", "\n\n", "")]

# --------------------------------------------------------------------------
# Response clean-up (second stage)
# --------------------------------------------------------------------------
LEAKAGE_PATTERNS = [
    r"Thanks are due to scientists[^.]*\.",
    r"Thanks are due to[^.]*namely[^.]*\.",
    r"The support received from[^.]*\.",
    r"for data compilation[^.]*\.",
    r"Farmers FIRST project[^.]*\.",
    r"Ms\.?\s*Laxmi Prasanna[^.]*\.",
    r"SRF for data[^.]*\.",
    r"Laxmi Prasanna,?\s*SRF\s*Madhusudhana",
    r"Laxmi Prasanna,?\s*SRF",
    r"SRF\s*Madhusudhana",
    r"The ICAR-Indian Institute of Millets Research[^.]*\.",
    r"ICAR-Indian Institute of Millets Research[^.]*\.",
    r"ABOUT THE INSTITUTE[^.]*\.",
    r"was established in \d{4}[^.]*\.",
    r"nodal centre for improving[^.]*\.",
    r"Thank you for your interest in our publication[^.]*\.",
    r"We hope that the information given in this bulletin[^.]*\.",
    r"will assist the extension personnel[^.]*\.",
    r"state department officials[^.]*\.",
    r"other millet workers[^.]*\.",
    r"This helps users quickly find[^.]*\.",
    r"For best results, consult local[^.]*\.",
    r"The information contained in this technical bulletin[^.]*\.",
    r"would help to create the much needed awareness[^.]*\.",
    r"I appreciate the efforts put in by the scientists[^.]*\.",
    r"Lam confident that the information[^.]*\.",
    r"I am confident that the information[^.]*\.",
    r"assist the farmers and extension workers[^.]*\.",
    r"bringing out this bulletin[^.]*\.",
    r"in an impressive manner[^.]*\.",
    r"[Ff]oreword[^.]*\.",
    r"[Aa]cknowledgement[^.]*\.",
    r"AICRP on Small Millets[^.]*\.",
    r"Project Co-?ordinator[^.]*\.",
    r"PzQo-\([^)]*\)",
    r"\(PRABHAKAR\)[^.]*\.",
    r"Date:\s*\d{1,2}-\d{1,2}-\d{4}[^.]*\.",
    r"Place:\s*Bengaluru[^.]*\.",
    r"during the year \d{4}[^.]*\.",
    r"This information is based on verified agricultural research and government sources\.?",
    r"Since,? these recommendations and advisory originate from the research system[^.]*\.",
    r"Any damage or loss resulting from the use of this book[^.]*\.",
    r"Published by:\s*Director[^.]*INDIA\.?",
    r"Printed at:\s*Balajiscan[^.]*\.?",
    r"Cell:\s*\d+[^.]*\.?",
    r"Balajiscan Private Limited[^,]*,?",
    r"https?://[^\s]*balaji[^\s]*",
    r"www\.[^\s]*balaji[^\s]*",
    r"Balaji[Ss]can[^.]*\.",
    r": https://www\.[^\s]+",
    r"\(ISBN:[^)]+\)",
    r"\|\s*Variety\s*\|\s*Region\s*\|+",
    r"\|\s*\|+\s*$",
    r"Choose the best variety based on your location[^.]*\.",
    r"farmers and extension personnel[^.]*\.",
    r"crop growing conditions, and plant protection technologies[^.]*\.",
    r"on the latest released varieties[^.]*\.",
    r"increase foxtail millet production[^.]*\.",
    r"EXTRA CREDIT[^.]*\.",
    r"EXTRA CREDIT:[^\n]*",
    r"Please provide accurate information[^.]*\.",
    r"Please feel free to ask[^.]*\.",
    r"Thanks for chatting[^.]*\.",
    r"About Proso Millet[^:]*:",
    r"\* Highest fibre content among cereals",
]
LEAKAGE_FLAGS = "i"
LEAKAGE_TIDY_RULES = [
    (r"  +", " ", ""),
    (r"\n{3,}", "\n\n", ""),
    (r"^\s*[\*\-]\s*$", "", "m"),
    (r"\n\s*\n\s*\n", "\n\n", ""),
]
SHORT_TEXT_LIMIT = 20
SHORT_TEXT_FALLBACK = ("I couldn't find specific information about that in my knowledge base. "
                       "Could you rephrase your question?")

SPECIES_CORRECTIONS = [
    (r"barnyard\s+millet\s*(?:is|are|=|,)?\s*(?:also\s+)?(?:known\s+as|called|the\s+same\s+as)?\s*"
     r"(?:chena|proso\s+millet)",
     "Barnyard millet (Echinochloa species) is DIFFERENT from Chena/Proso millet (Panicum miliaceum)"),
    (r"pearl\s+millet\s+(?:has|contains|is\s+known\s+for)?\s*(?:the\s+)?highest\s+calcium",
     "Finger Millet (Ragi) has the highest calcium content among millets (~350mg per 100g)"),
]
SPECIES_FLAGS = "i"

OCR_RULES = [
    (r"\*\*_+[^*]*\*\*", "**[data unavailable]**", ""),
    (r"\*\*contains \*\*_+", "**contains approximately", ""),
    (r"_protein per \*\*", "protein per 100g**", ""),
    (r"(\d+\.?\d*)\s*_+\s*(g|mg|%)", r"\1\2", ""),
    (r"_+(\d+\.?\d*)\s*(g|mg|%)", r"\1\2", ""),
    (r"\*\*\s*\*\*", "", ""),
    (r"\*\*_+\*\*", "", ""),
]

# Subject validation: (subject in the question, wrong subjects in the answer).
SUBJECT_CONFUSIONS = [
    ("jowar", ["kuttu", "buckwheat", "kutki", "little millet"]),
    ("sorghum", ["kuttu", "buckwheat", "kutki", "little millet"]),
    ("bajra", ["kuttu", "buckwheat", "ragi", "finger millet"]),
    ("pearl millet", ["kuttu", "buckwheat", "ragi", "finger millet"]),
    ("ragi", ["kuttu", "buckwheat", "jowar", "sorghum"]),
    ("finger millet", ["kuttu", "buckwheat", "jowar", "sorghum"]),
    ("kangni", ["kodo", "barnyard", "proso"]),
    ("foxtail", ["kodo", "barnyard", "proso"]),
]
SUBJECT_DISH_SUFFIXES = [" puri", " roti"]
SUBJECT_LEAD_CHARS = 100
SUBJECT_APOLOGY = ("I apologize, but I couldn't find a specific recipe for **{title}** in my knowledge base. "
                   "However, {title} can be used to make rotis, dosas, porridges, and various traditional "
                   "dishes. Would you like me to provide general cooking instructions?")

FARMING_PATTERNS = [
    r"[^.]*\b(?:inoculat|thiram|carbendazim|fungicide|pesticide|insecticide)\b[^.]*\.\s*",
    r"[^.]*\b(?:caterpillar|larvae|pest|insect pest|borer|aphid|mite)\b[^.]*\.\s*",
    r"[^.]*\b(?:seed treatment|soilborne disease|vector population)\b[^.]*\.\s*",
    r"[^.]*\b(?:sudan grass|johnson grass|alternate host)\b[^.]*\.\s*",
    r"[^.]*\bvegetative phase\b[^.]*\bdefoliation\b[^.]*\.\s*",
    r"[^.]*\b(?:sowing|transplanting|irrigation schedule|fertilizer application)\b[^.]*\.\s*",
    r"[^.]*\b(?:yield per hectare|crop rotation|field preparation)\b[^.]*\.\s*",
]
OFF_TOPIC_NUTRITION_PATTERNS = [
    r"[^.]*\bdrought\s+tolerance\s+is\s+(?:very\s+)?(?:high|low|medium)\b[^.]*\.\s*",
    r"[^.]*\bbased\s+on\s+these\s+ratings[^.]*\.\s*",
    r"[^.]*\bwater-scarce\s+conditions\b[^.]*\.\s*",
    r"[^.]*\b(?:sowing|transplanting|irrigation|cultivation)\b[^.]*\.\s*",
    r"\*\*[^*]+:\*\*\s*Drought\s+tolerance[^.]*\.\s*",
]
TOPIC_FILTER_FLAGS = "i"
TOPIC_TIDY_RULES = [
    (r"\s{2,}", " ", ""),
    (r"\n{3,}", "\n\n", ""),
]

# Reasoning / answer split.
ANSWER_MARKERS = ["Winner:", "In conclusion", "My recommendation", "The answer is", "To summarize",
                  "Overall,", "Therefore,"]
MIN_THINKING_CHARS = 50          # marker index must be > 50
MIN_ANSWER_CHARS = 80            # answer must be longer than 80
TRANSITION_PATTERNS = [
    r"^based\s+on[^:;.]*[:;.\-]+\s*",
    r"^from\s+the\s+above[^:;.]*[:;.\-]+\s*",
    r"^so\s*,?\s*",
    r"^\*\s*",
]
TRANSITION_FLAGS = "i"
ANSWER_TIDY_RULES = [
    (r"_+([;,.])", r"\1", ""),
    (r"\*\*([^*]+)_+\*\*", r"**\1**", ""),
    (r"_+\s*;", ";", ""),
]
THINKING_TIDY_RULES = [
    (r"_+([;,.])", r"\1", ""),
    (r"\*\*([^*]+)_+\*\*", r"**\1**", ""),
    (r"\*", "", ""),
]
ANSWER_FINAL_RULES = [
    (r"\*", "", ""),
    (r"  +", " ", ""),
]

# Citation envelope.
CITATION_SPLIT = "---"
CITATION_BULLETS = ("-", "*")
CITATION_LSTRIP = "-* "
CITATION_DEFAULT = named("{assistant} Knowledge Base")
CITATION_KEEP = 3
