"""Fixed values.

Everything in this module is a value that has to be exactly what the
original scripts use, otherwise results differ: keyword lists, unit
factors, category patterns, sentinels and the text templates of the
hand-off tables. They are written out plainly, in the order the
original applies them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — sentinels
# ---------------------------------------------------------------------------
NOT_SPECIFIED = "Not specified"        # whole-cell null marker of raw extractions
UNKNOWN_GAS = "Unknown"                # gas text that is null
OTHER_GAS = "Other"                    # gas text naming none of the four gases
NO_DATA = "No Data"                    # dashboard text when a statistic is empty
UNKNOWN_SECTION = "Unknown Section"    # heading of a section without <head>
CAPTION_MARK = "Table Caption:"        # first cell of a table's caption row

# Raw extraction keys, in request order (the JSON object of one paper).
RAW_KEYS = [
    "Material",
    "Substrate",
    "Deposition_Method",
    "Target",
    "Power",
    "Gas_Mixture",
    "Working_Pressure",
    "Base_Pressure",
    "Temperature",
    "Film_Thickness",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — paragraph relevance keywords (lower-case substring test)
# ---------------------------------------------------------------------------
PARAGRAPH_KEYWORDS = [
    "sputter", "magnetron", "deposition", "co-sputtering", "hipims",
    "rf power", "dc power", "pulsed dc", "power density", "watt", " w ", "w/cm",
    "argon", " ar ", "nitrogen", " n2 ", "oxygen", " o2 ", "flow rate", "sccm", "gas mixture", "ratio",
    "pressure", "mtorr", "torr", "mbar", "pascal", " pa ", "base vacuum", "background pressure",
    "target-to-substrate", "distance", "rotation", "rpm", "deposition time", "deposition rate", "nm/min", "Å/s",
    "temperature", "heater", "substrate temp", "anneal", "celsius", "°c",
    "target", "substrate", "bias", "chamber", "cathode",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — deposition-method keywords (lower-case substring test).
# The published list has a missing comma, so 'Sputter' and 'magnetron'
# form one entry; upper-case entries can never match lower-cased text.
# ---------------------------------------------------------------------------
METHOD_KEYWORDS = [
    "sputter",
    "Sputtermagnetron",
    "hipims",
    "ibs",
    "ion beam",
    "rfms",
    "dcms",
    "pulsed dc",
    "sputterring",
    "Sputterring",
]
# Preset with the evident intent (comma restored).
METHOD_KEYWORDS_CORRECTED = [
    "sputter",
    "Sputter",
    "magnetron",
    "hipims",
    "ibs",
    "ion beam",
    "rfms",
    "dcms",
    "pulsed dc",
    "sputterring",
    "Sputterring",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — measurement patterns and unit factors
# ---------------------------------------------------------------------------
# Split of a multi-value field (power also splits on ';').
SPLIT_PATTERN = r",|\band\b"
POWER_SPLIT_PATTERN = r",|\band\b|;"
# what a text holds if its pattern splits it
SPLIT_MARKS = {SPLIT_PATTERN: [",", "and"], POWER_SPLIT_PATTERN: [",", "and", ";"]}

# base, exponent, unit
PRESSURE_PATTERN = r"([0-9\.]+)(?:[xe\*]10\^?|\^|e)?([\-0-9]*)([a-z]+)"
# A part whose text contains one of these applies the exponent.
PRESSURE_EXPONENT_MARKS = ["x10", "e", "*10"]
# (unit substring, operation, operand) to pascal, tested in this order;
# the first unit the captured unit text contains wins.
PRESSURE_UNITS = [
    ("mtorr", "*", 0.133322),
    ("torr", "*", 133.322),
    ("mbar", "*", 100.0),
    ("bar", "*", 100000.0),
    ("pa", "*", 1.0),
    ("mpa", "/", 1000.0),
]

TEMPERATURE_PATTERN = r"(-?[0-9\.]+)(?:-[0-9\.]+)?(c|k)"
ROOM_TEMPERATURE_MARKS = ["rt", "room"]
ROOM_TEMPERATURE_C = 25.0
KELVIN_OFFSET = 273.15

THICKNESS_PATTERN = r"([0-9\.]+)(?:-[0-9\.]+)?(nm|um|μm|a|mm)"
# (unit, operation, operand) to nanometre; the captured unit equals one of them
THICKNESS_UNITS = [("um", "*", 1000.0), ("μm", "*", 1000.0), ("a", "/", 10.0), ("mm", "*", 1000000.0), ("nm", "*", 1.0)]

POWER_PATTERN = r"([0-9\.]+)(?:-[0-9\.]+)?(kw|w|mw)"
# (unit, operation, operand) to watt; the captured unit equals one of them
POWER_UNITS = [("kw", "*", 1000.0), ("mw", "/", 1000.0), ("w", "*", 1.0)]

# gas label -> lower-case substrings that name it, in output order
GAS_TERMS = [
    ("Ar", ["ar", "argon"]),
    ("O2", ["o2", "oxygen"]),
    ("N2", ["n2", "nitrogen"]),
    ("H2", ["h2", "hydrogen"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — substrate classes (tested on upper-cased text).
# Listed in the order the original assigns them; a later hit overwrites an
# earlier one, and 'Silicon (Si)' only applies when nothing else did.
# ---------------------------------------------------------------------------
SUBSTRATE_OTHER = "Other / Complex"
SUBSTRATE_CLASSES = [
    ("Glass", "GLASS|CORNING|SODA-LIME|QUARTZ"),
    ("SiO2 / Si", "SIO2/SI|SI/SIO2|OXIDIZED SILICON"),
    ("ITO", "ITO"),
    ("Sapphire", "SAPPHIRE|AL2O3"),
    ("Polymers (PET/PEN)", "PET|PEN|POLYETHYLENE|PLASTIC|KAPTON"),
]
SUBSTRATE_SILICON = ("Silicon (Si)", "SI|SILICON")
# normalised substrate texts that mean "no substrate"
SUBSTRATE_NULL_TEXTS = ["Nan", "Not Specified"]

# ---------------------------------------------------------------------------
# FIXED VALUES — histogram bins and search sizes
# ---------------------------------------------------------------------------
EDA_BINS = {"power_w": 40, "working_pressure_pa": 40, "temperature_c": 30, "thickness_nm": 40}
DASHBOARD_BINS = 50
THICKNESS_PLOT_LIMIT_NM = 2000.0
MACRO_K = 50
MICRO_K = 10

# ---------------------------------------------------------------------------
# FIXED VALUES — family alias table used by the family queries
# ---------------------------------------------------------------------------
FAMILY_ALIASES = [
    ("ZnO", "ZnO"),
    ("ZnO", "Zinc oxide"),
    ("ZnO", "ZnO:Al"),
    ("TiO2", "TiO2"),
    ("YBCO", "YBCO"),
    ("TiN", "TiN"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — text templates of the hand-off tables
# ---------------------------------------------------------------------------
EXTRACTION_REQUEST_TEMPLATE = """
    You are an expert materials scientist specializing in thin film deposition and sputtering. 
    Read the provided text and extract the following parameters. 
    Return ONLY a valid JSON object with these exact keys. Do not include any markdown formatting or extra text.
    If a parameter is not mentioned in the text, assign its value as "Not specified".

    Keys to extract:
    - "Material"
    - "Substrate"
    - "Deposition_Method"
    - "Target"
    - "Power" 
    - "Gas_Mixture" 
    - "Working_Pressure" 
    - "Base_Pressure"
    - "Temperature"
    - "Film_Thickness"

    Text to analyze:
    {text}
    """

FAMILY_REQUEST_TEMPLATE = """
                The user is researching the thin film material: '{family}'. 
                Here is a list of raw material names found in our database: {names}
                Which of these raw names belong to the '{family}' family? (Include alternate chemical formulas and obvious typos).
                Return ONLY a comma-separated list of the exact matching strings from the list. Do not write any other text.
                """

ANSWER_REQUEST_TEMPLATE = """
                You are an expert materials science AI assistant helping an engineering student with their Undergraduate Project (UGP).
                Your goal is to answer the user's question using ONLY the provided Database Context.

                CRITICAL RULES:
                1. NEVER guess, hallucinate, or bring in outside knowledge. 
                2. ALWAYS state the exact numerical parameters.
                3. MISSING DATA: If a parameter's value says "Not specified", "NaN", or "None", completely omit it.
                4. AGGREGATION GUARDRAIL (IMPORTANT): If the user asks for statistics, counting, averages, "most common", or "maximum" usage across the database, you MUST refuse to answer. Reply with: *"I am the Micro-Retrieval bot for specific paper queries. For dataset-wide statistics (like most common methods or averages), please use the 'Macro View (Tab 1)'."*
                5. NO MATCHES: If nothing matches, say "I cannot find the answer in the current database."

                Database Context:
                {context}

                User Question:
                {question}
                """

# Source list of an answer: header, then one line per hit.
SOURCES_HEADER = "\n\n**📚 Sources Used:**\n"
SOURCE_LINE = "- *Paper ID:* {paper_id} ({material})\n"

# One collection document per paper row (numbers rendered by a fixed rule).
DOCUMENT_TEMPLATE = (
    "To deposit {material} on a {substrate} substrate using {method}, "
    "the process used a {gas} gas mixture. "
    "The parameters were: Power = {power} W, "
    "Working Pressure = {working_pressure} Pa, Base Pressure = {base_pressure} Pa, "
    "Temperature = {temperature} C. "
    "The resulting film thickness was {thickness} nm."
)

# Response fences of a model reply.
JSON_FENCE = "```json"
BARE_FENCE = "```"

# Paper-id suffixes stripped from file names, in order.
PAPER_FILE_SUFFIXES = [".grobid.tei.xml", ".xml"]
EXTRACTION_FILE_SUFFIX = "_extracted.json"

# Whitespace as Python's str.isspace() sees it, as a regex class valid in
# both Java regex and RE2.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Bracketed numeric citation lists such as [1] or [2, 3].
CITATION_PATTERN = r"\[\p{Nd}+(?:," + PY_WHITESPACE_CLASS + r"*\p{Nd}+)*\]"

# ---------------------------------------------------------------------------
# FIXED VALUES — chemistry: element symbols, names of elements and anions
# ---------------------------------------------------------------------------
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd "
    "Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th "
    "Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
ELEMENT_WORDS = [
    ("aluminium", "Al"), ("aluminum", "Al"), ("barium", "Ba"), ("bismuth", "Bi"), ("boron", "B"), ("cadmium", "Cd"),
    ("calcium", "Ca"), ("carbon", "C"), ("cerium", "Ce"), ("chromium", "Cr"), ("cobalt", "Co"), ("copper", "Cu"),
    ("gallium", "Ga"), ("germanium", "Ge"), ("gold", "Au"), ("hafnium", "Hf"), ("indium", "In"), ("iron", "Fe"),
    ("lanthanum", "La"), ("lead", "Pb"), ("lithium", "Li"), ("magnesium", "Mg"), ("manganese", "Mn"),
    ("molybdenum", "Mo"), ("nickel", "Ni"), ("niobium", "Nb"), ("platinum", "Pt"), ("silicon", "Si"),
    ("silver", "Ag"), ("strontium", "Sr"), ("tantalum", "Ta"), ("tin", "Sn"), ("titanium", "Ti"),
    ("tungsten", "W"), ("vanadium", "V"), ("yttrium", "Y"), ("zinc", "Zn"), ("zirconium", "Zr"),
]
ANION_WORDS = [
    ("oxide", "O"), ("nitride", "N"), ("carbide", "C"), ("sulfide", "S"), ("sulphide", "S"), ("selenide", "Se"),
    ("telluride", "Te"), ("fluoride", "F"), ("chloride", "Cl"), ("boride", "B"), ("silicide", "Si"), ("phosphide", "P"),
]
NAME_PREFIXES = [("mono", 1.0), ("mon", 1.0), ("di", 2.0), ("tri", 3.0), ("tetra", 4.0), ("tetr", 4.0), ("penta", 5.0), ("pent", 5.0), ("hexa", 6.0)]
MATERIAL_ACRONYMS = [("YBCO", "YBa2Cu3O7"), ("ITO", "In2O3"), ("AZO", "ZnO"), ("BTO", "BaTiO3"), ("STO", "SrTiO3")]
#: Other spellings of the derived table's materials (test data of the family grouping).
NAME_VARIANTS = [
    ("ZnO", ["OZn", "Al-doped ZnO", "AZO", "Zn1O1"]),
    ("Zinc oxide", ["Zinc oxid", "Zinc  Oxide", "Znic oxide", "zinc monoxide"]),
    ("TiO2", ["O2Ti", "Titanium dioxide", "Titanium dioxde", "titanium(IV) oxide"]),
    ("YBCO", ["YBa2Cu3O7", "Cu3Ba2YO7", "ybco"]),
    ("TiN", ["Titanium nitride", "NTi", "Titanum nitride"]),
]
