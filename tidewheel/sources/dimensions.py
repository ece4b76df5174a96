"""Reference dimensions: small fixed tables, and readers for the large ones.

The member universe and the display names are too long to state here; both are
tables the caller supplies (``read_universe``, ``read_names``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The benchmark fund, and the day from which history is kept.
BENCHMARK = "SPY"
HISTORY_START = "2010-01-01"

# Sector funds (etf, name).
SECTORS = [
    ("XLK", "Technology"),
    ("XLF", "Financials"),
    ("XLY", "Consumer Disc."),
    ("XLP", "Consumer Staples"),
    ("XLE", "Energy"),
    ("XLV", "Health Care"),
    ("XLI", "Industrials"),
    ("XLB", "Materials"),
    ("XLU", "Utilities"),
    ("XLRE", "Real Estate"),
    ("XLC", "Comm. Services"),
    ("SOXX", "Semiconductors"),
    ("XRT", "Retail"),
    ("IBB", "Biotech"),
    ("KRE", "Reg. Banks"),
    ("ITA", "Aerospace/Defense"),
    ("XOP", "Oil & Gas E&P"),
    ("OIH", "Oil Services"),
    ("GDX", "Gold Miners"),
    ("ICLN", "Clean Energy"),
    ("JETS", "Airlines"),
    ("XHB", "Homebuilders"),
]

# Metals (name, ticker, unit, symbol, whether the ticker is a proxy).
METALS = [
    ("Gold", "GC=F", "$/troy oz", "Au", False),
    ("Silver", "SI=F", "$/troy oz", "Ag", False),
    ("Platinum", "PL=F", "$/troy oz", "Pt", False),
    ("Palladium", "PA=F", "$/troy oz", "Pd", False),
    ("Copper", "HG=F", "$/lb", "Cu", False),
    ("Aluminum", "ALI=F", "$/lb", "Al", False),
    ("Steel (HRC)", "HRC=F", "$/ton", "Fe", False),
    ("Crude Oil", "CL=F", "$/barrel", "Oil", False),
    ("Rare Earths", "REMX", "$ (REMX ETF)", "RE", True),
    ("Lithium", "LIT", "$ (LIT ETF)", "Li", True),
    ("Cobalt", "VALE", "$ (Vale ADR)", "Co", True),
]

# Metal companies (group, company, ticker, country, exchange).
METAL_COMPANIES = [
    ("Aluminum", "Hindalco Industries", "HINDALCO.NS", "India", "NSE"),
    ("Aluminum", "Vedanta Ltd", "VEDL.NS", "India", "NSE"),
    ("Aluminum", "NALCO", "NATIONALUM.NS", "India", "NSE"),
    ("Aluminum", "Alcoa Corp", "AA", "USA", "NYSE"),
    ("Aluminum", "Century Aluminum", "CENX", "USA", "NASDAQ"),
    ("Aluminum", "Norsk Hydro", "NHYDY", "Norway", "OTC"),
    ("Aluminum", "Rio Tinto", "RIO", "Australia/UK", "NYSE"),
    ("Copper", "Freeport-McMoRan", "FCX", "USA", "NYSE"),
    ("Copper", "Southern Copper", "SCCO", "Peru/USA", "NYSE"),
    ("Copper", "Antofagasta", "ANTO.L", "Chile", "LSE"),
    ("Copper", "First Quantum Min.", "FM.TO", "Canada/Zambia", "TSX"),
    ("Copper", "Ivanhoe Mines", "IVN.TO", "Canada/DRC", "TSX"),
    ("Copper", "Hindalco (Cu)", "HINDALCO.NS", "India", "NSE"),
    ("Gold", "Newmont Corp", "NEM", "USA", "NYSE"),
    ("Gold", "Barrick Gold", "GOLD", "Canada", "NYSE"),
    ("Gold", "Agnico Eagle Mines", "AEM", "Canada", "NYSE"),
    ("Gold", "Kinross Gold", "KGC", "Canada", "NYSE"),
    ("Gold", "Gold Fields", "GFI", "South Africa", "NYSE"),
    ("Gold", "AngloGold Ashanti", "AU", "South Africa", "NYSE"),
    ("Gold", "Zijin Mining", "ZIJMY", "China", "OTC"),
    ("Silver", "Wheaton Prec. Metals", "WPM", "Canada", "NYSE"),
    ("Silver", "Pan American Silver", "PAAS", "Canada", "NASDAQ"),
    ("Silver", "First Majestic Silver", "AG", "Canada/Mexico", "NYSE"),
    ("Silver", "Coeur Mining", "CDE", "USA", "NYSE"),
    ("Steel", "Tata Steel", "TATASTEEL.NS", "India", "NSE"),
    ("Steel", "JSW Steel", "JSWSTEEL.NS", "India", "NSE"),
    ("Steel", "SAIL", "SAIL.NS", "India", "NSE"),
    ("Steel", "ArcelorMittal", "MT", "Luxembourg", "NYSE"),
    ("Steel", "Nucor Corporation", "NUE", "USA", "NYSE"),
    ("Steel", "Posco Holdings", "PKX", "South Korea", "NYSE"),
    ("Steel", "Steel Dynamics", "STLD", "USA", "NASDAQ"),
    ("Nickel", "Vale S.A.", "VALE", "Brazil", "NYSE"),
    ("Nickel", "IGO Limited", "IGO.AX", "Australia", "ASX"),
    ("Zinc", "Hindustan Zinc", "HINDZINC.NS", "India", "NSE"),
    ("Zinc", "Teck Resources", "TECK", "Canada", "NYSE"),
    ("Platinum/Palladium", "Sibanye Stillwater", "SBSW", "South Africa", "NYSE"),
    ("Platinum/Palladium", "Impala Platinum", "IMPUY", "South Africa", "OTC"),
    ("Platinum/Palladium", "Anglo Amer. Platinum", "ANGPY", "South Africa", "OTC"),
    ("Rare Earths", "MP Materials", "MP", "USA", "NYSE"),
    ("Rare Earths", "Energy Fuels", "UUUU", "USA", "NYSE"),
    ("Rare Earths", "Lynas Rare Earths", "LYSCF", "Australia", "OTC"),
    ("Rare Earths", "Iluka Resources", "ILU.AX", "Australia", "ASX"),
    ("Lithium", "Albemarle Corp", "ALB", "USA", "NYSE"),
    ("Lithium", "SQM", "SQM", "Chile", "NYSE"),
    ("Lithium", "Arcadium Lithium", "ALTM", "USA/Australia", "NYSE"),
    ("Lithium", "Pilbara Minerals", "PILBF", "Australia", "OTC"),
    ("Lithium", "Sigma Lithium", "SGML", "Brazil", "NASDAQ"),
    ("Lithium", "Lithium Americas", "LAC", "Canada", "NYSE"),
    ("Cobalt", "Glencore", "GLNCY", "Switzerland", "OTC"),
    ("Cobalt", "Vale S.A.", "VALE", "Brazil", "NYSE"),
    ("Diversified Miners", "BHP Group", "BHP", "Australia", "NYSE"),
    ("Diversified Miners", "Anglo American", "NGLOY", "UK", "OTC"),
    ("Diversified Miners", "Vedanta Ltd", "VEDL.NS", "India", "NSE"),
]

# Event types in order of precedence (type, pressure, colour, keywords).
EVENT_TYPES = [
    ("Plant/Smelter Closure", "UP", "red", [
        "closure", "closed", "shut down", "shutdown", "idle", "idled", "halt", "halted", "curtailment", "curtailed", "suspended", "mothballed",
        "offline", "production stop",
    ]),
    ("Labor Strike", "UP", "orange", [
        "strike", "labor dispute", "labour dispute", "worker dispute", "union", "walkout", "protest", "industrial action", "work stoppage",
    ]),
    ("Geopolitical", "?", "purple", [
        "sanctions", "sanctioned", "tariff", "trade war", "trade ban", "embargo", "conflict", "war", "export ban", "export restriction",
        "import ban", "nationalization", "nationalized", "seized", "coup",
    ]),
    ("Natural Disaster", "UP", "teal", [
        "earthquake", "flood", "flooded", "flooding", "hurricane", "typhoon", "landslide", "storm", "wildfire", "fire destroyed", "tsunami",
        "volcanic", "drought",
    ]),
    ("Energy Crisis", "UP", "yellow", [
        "power shortage", "electricity shortage", "energy crisis", "blackout", "power cut", "power outage", "power disruption", "gas shortage",
        "energy shortage", "load shedding",
    ]),
    ("Supply Deficit", "UP", "pink", [
        "shortage", "deficit", "undersupply", "supply gap", "tight supply", "low inventory", "inventory drop", "stockpile decline", "supply crunch",
    ]),
    ("Demand Surge", "UP", "green", [
        "demand surge", "demand increase", "record demand", "electric vehicle demand", "EV demand", "battery demand", "data center demand",
        "infrastructure boom",
    ]),
    ("New Supply", "DOWN", "lime", [
        "new mine", "mine opening", "capacity expansion", "ramp up", "production increase", "restart", "reopened", "resumes production",
    ]),
    ("Regulatory", "UP", "gray", [
        "permit revoked", "permit denied", "environmental ruling", "EPA", "environmental ban", "compliance failure", "license suspended",
        "ordered to stop", "court order",
    ]),
]

# Metals of headlines (metal, keywords).
METAL_KEYWORDS = [
    ("Gold", ["gold", "bullion"]),
    ("Silver", ["silver"]),
    ("Copper", ["copper"]),
    ("Aluminum", ["aluminum", "aluminium", "bauxite", "qatalum", "alcoa"]),
    ("Nickel", ["nickel"]),
    ("Cobalt", ["cobalt"]),
    ("Lithium", ["lithium"]),
    ("Zinc", ["zinc"]),
    ("Lead", ["lead"]),
    ("Tin", ["tin"]),
    ("Platinum", ["platinum", "pgm", "pge"]),
    ("Palladium", ["palladium"]),
    ("Steel", ["steel", "iron ore", "hrc", "blast furnace"]),
    ("Crude Oil", ["crude", "crude oil", "petroleum"]),
    ("Rare Earths", [
        "rare earth", "rare-earth", "ree", "neodymium", "dysprosium", "lanthanum", "cerium", "praseodymium", "terbium", "erbium", "yttrium",
        "scandium", "europium", "gadolinium", "holmium", "samarium",
    ]),
    ("Manganese", ["manganese"]),
]

# Countries of headlines, in order of precedence.
COUNTRIES = [
    "China", "India", "USA", "United States", "Australia", "Russia", "Chile", "Peru", "Brazil", "Indonesia", "Philippines", "Congo", "DR Congo",
    "Zambia", "Zimbabwe", "South Africa", "Canada", "Norway", "Qatar", "Bahrain", "Guinea", "Ghana", "Kazakhstan", "Myanmar", "Mexico", "Bolivia",
    "Japan", "South Korea", "Germany", "France", "UK", "Britain", "Iran", "Saudi Arabia", "UAE", "Argentina", "Colombia", "Papua New Guinea",
    "Mozambique", "Tanzania", "Mali", "Sweden", "Finland", "Mongolia",
]

# Feeds in order (address, publisher); search feeds name no publisher.
NEWS_SOURCES = [
    ("https://www.mining.com/feed/", "Mining.com"),
    ("https://www.kitco.com/rss/", "Kitco"),
    ("https://www.miningweekly.com/rss/", "Mining Weekly"),
    ("https://northernminer.com/feed/", "Northern Miner"),
    ("https://news.google.com/rss/search?q=smelter+closure+production+halt+shutdown&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=mine+strike+labor+dispute+copper+zinc+nickel&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=metal+production+cut+output+reduction+curtailment&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=mining+flood+earthquake+disaster+production&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=energy+crisis+smelter+power+shortage+aluminum&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=metal+commodity+sanctions+tariff+export+ban&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=copper+aluminum+nickel+supply+disruption+shortage&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=gold+silver+mine+closure+suspended+output&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=platinum+palladium+supply+deficit+mine&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=steel+iron+ore+blast+furnace+supply+shortage&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=copper+mine+chile+peru+zambia+congo+disruption&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=rare+earth+neodymium+china+supply+ban+export&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=rare+earth+mine+closure+production+lynas+materials&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=lithium+cobalt+supply+shortage+mine+disruption&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=lithium+price+supply+deficit+australia+chile&hl=en-US&gl=US&ceid=US:en", None),
    ("https://news.google.com/rss/search?q=cobalt+congo+DRC+mine+supply+disruption&hl=en-US&gl=US&ceid=US:en", None),
]


def event_types() -> list[tuple[str, str, str, list[str]]]:
    """(type, pressure, colour, keywords) in precedence order."""
    return EVENT_TYPES


def metal_keywords() -> list[tuple[str, list[str]]]:
    return METAL_KEYWORDS


def countries() -> list[str]:
    return COUNTRIES


def sectors(spark: SparkSession) -> DataFrame:
    data = [(etf, name, i) for i, (etf, name) in enumerate(SECTORS)]
    return spark.createDataFrame(data, "etf string, name string, ord int")


def metals(spark: SparkSession) -> DataFrame:
    data = [(*row, i) for i, row in enumerate(METALS)]
    return spark.createDataFrame(data, "name string, ticker string, unit string, symbol string, proxy boolean, ord int")


def metal_companies(spark: SparkSession) -> DataFrame:
    groups = list(dict.fromkeys(r[0] for r in METAL_COMPANIES))
    data = [(*r, groups.index(r[0]), i) for i, r in enumerate(METAL_COMPANIES)]
    return spark.createDataFrame(
        data, "`group` string, name string, ticker string, country string, exchange string, group_ord int, ord int")


def event_type_dim(spark: SparkSession) -> DataFrame:
    data = [(*t[:3], i, t[3]) for i, t in enumerate(event_types())]
    return spark.createDataFrame(data, "etype string, pressure string, color string, ord int, keywords array<string>")


def metal_keyword_dim(spark: SparkSession) -> DataFrame:
    data = [(*m, i) for i, m in enumerate(metal_keywords())]
    return spark.createDataFrame(data, "metal string, keywords array<string>, ord int")


def country_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(countries())], "country string, ord int")


def news_sources(spark: SparkSession) -> DataFrame:
    """Publisher feeds, then search feeds, which name no publisher."""
    data = [(*row, i) for i, row in enumerate(NEWS_SOURCES)]
    return spark.createDataFrame(data, "source_id string, publisher string, source_ord int")


def explode_universe(lists: DataFrame) -> DataFrame:
    """``(etf, etf_ord, tickers array)`` to one row per membership, repeats kept."""
    return lists.select("etf", "etf_ord", F.posexplode("tickers").alias("ord", "ticker"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Membership table from CSV with header ``etf,ticker,etf_ord,ord``."""
    return spark.read.schema("etf string, ticker string, etf_ord int, ord int").csv(path, header=True)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Display names from CSV with header ``ticker,name``."""
    return spark.read.schema("ticker string, name string").csv(path, header=True)


def all_symbols(universe: DataFrame, sector_table: DataFrame, benchmark: str) -> DataFrame:
    """Distinct benchmark, sector and member symbols."""
    spark = universe.sparkSession
    bench = spark.range(1).select(F.lit(benchmark).alias("symbol"))
    return (
        universe.select(F.col("ticker").alias("symbol"))
        .union(sector_table.select("etf")).union(bench).distinct()
    )
