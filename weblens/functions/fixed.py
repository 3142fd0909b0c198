"""Values that results depend on, as published by the crawlers' operators or set by the detection rules."""

# Extensions of what a browser loads along with a page.
ASSET_EXTENSIONS = ("css", "js", "mjs", "map", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "avif", "woff", "woff2", "ttf", "otf", "eot")

# How a user agent declares that it is a program. Letters are lower-case.
BOT_WORDS = (
    r"(bot|crawler|spider|scraper|slurp)([^a-z]|$)|curl/|wget/|python-requests|python-urllib|scrapy|go-http-client|java/|libwww"
    r"|okhttp|httpx/|aiohttp|phantomjs|headlesschrome|facebookexternalhit|feedfetcher|pingdom|uptimerobot|nagios|monitor|probe"
)
CUBOT = r"cubot[ _-]"

# What a user agent holds that claims to be of a crawler family, in order.
FAMILY_MARKERS = (("googlebot", "googlebot"), ("bingbot", "bingbot"), ("msnbot", "bingbot"))

# Published address ranges of crawler families.
CRAWLER_RANGES = {
    "googlebot": """
        66.249.64.0/19 192.178.4.0/24 192.178.5.0/27 192.178.6.0/23 34.100.182.96/28 34.101.50.144/28 34.118.254.0/28
        34.118.66.0/28 34.126.178.96/28 34.146.150.144/28 34.147.110.144/28 34.151.74.144/28 34.152.50.64/28
        34.154.114.144/28 34.155.98.32/28 34.165.18.176/28 34.175.160.64/28 34.176.130.16/28 34.22.85.0/27 34.64.82.64/28
        34.65.242.112/28 34.80.50.80/28 34.88.194.0/28 34.89.10.80/28 34.89.198.80/28 34.96.162.48/28 35.247.243.240/28
        2001:4860:4801::/48
    """,
    "bingbot": """
        157.55.39.0/24 207.46.13.0/24 40.77.167.0/24 13.66.139.0/24 13.66.144.0/28 52.167.144.0/28 13.67.10.16/28
        13.69.66.240/28 13.71.172.224/28 139.217.52.0/28 191.233.204.224/28 20.36.108.32/28 20.43.120.16/28
        40.79.131.208/28 40.79.186.176/28 52.231.148.0/28 20.79.107.240/28 51.105.67.0/28 20.125.163.80/28 40.77.188.0/22
        65.55.210.0/24 199.30.24.0/23 40.77.202.0/24 40.77.139.0/25 20.74.197.0/28 20.15.133.160/27 40.77.177.0/24
        40.77.178.0/23
    """,
}

#: Window and session lengths, seconds.
WINDOW_S, FANO_BIN_S, SESSION_GAP_S, FOLD_GAP_S, GRACE_S = 300, 30, 1800, 1800, 120
#: Caps of what one window or profile keeps.
MAX_PATHS, MAX_GAPS, MAX_BYTES, MAX_CHAIN, MAX_RAW = 4096, 2048, 2048, 4096, 10
MAX_PROFILE_PATHS, MAX_PROFILE_UAS, SERVED_MIN = 500_000, 100_000, 3
#: Gates of the two use cases.
RECON_GATE, RECON_EVENTS, RECON_PATHS = 0.997, 5, 3
BOT_GATE, BOT_EVENTS, BOT_STREAK = 0.995, 5, 6
DAILY_BUDGET, DOWNWEIGHT, BORDERLINE = 50, 25, 0.5
#: Drift and calibration.
PSI_BINS, PSI_EPS, PSI_HIGH, PSI_LOW, GRID = 10, 1e-6, 0.25, 0.10, 1001
CLIP_Q, DROP_SHARE, DROP_FROM, REFERENCE_CAP, LEAST_WINDOWS = 0.999, 0.001, 100, 5000, 20

# The names of a window's features, each with what it says.
PHRASES = {
    "web.ratio_404": "portion of requests answered with 404",
    "web.status_2xx_ratio": "portion answered with success",
    "web.status_3xx_ratio": "portion sent elsewhere by a redirect",
    "web.status_4xx_ratio": "portion refused as faulty",
    "web.status_5xx_ratio": "portion on which the server failed",
    "web.mean_path_idf": "how seldom others ask this server for these paths",
    "web.path_token_entropy": "how evenly the words of paths are spread",
    "web.uniq_paths_per_min": "different paths a minute",
    "web.unknown_ext_ratio": "portion asking for file types never served here",
    "web.referrer_absent_ratio": "portion without a referring page",
    "ua.len": "length of the agent's name",
    "ua.rarity": "how seldom this agent is seen on the server",
    "timing.interarrival_cv": "unevenness of the pauses between requests",
    "bot.asset_fetch_ratio": "portion fetching scripts, styles and pictures",
    "bot.activity_hour_entropy": "how evenly the client is active over the day",
    "bot.referrer_chain_depth": "longest walk from page to page",
    "bot.path_repeat_ratio": "portion asking for a path once more",
    "bot.method_get_ratio": "portion using GET",
    "bot.bytes_per_req_p50": "typical size of an answer in bytes",
    "bot.robots_txt_fetched": "whether the rules for robots were read",
    "bot.declared_bot": "whether the agent calls itself a robot",
    "timing.fano_factor": "how requests bunch together in time",
}


def column(feature: str) -> str:
    """The column that holds a feature: its name with underscores."""
    return feature.replace(".", "_")


FEATURES = tuple(column(f) for f in PHRASES)
#: What the two use cases look at.
RECON_FEATURES = tuple(c for c in FEATURES if c.startswith("web_")) + ("ua_len", "ua_rarity", "timing_interarrival_cv")
BOT_FEATURES = tuple(c for c in FEATURES if c.startswith(("bot_", "timing_"))) + ("ua_len", "ua_rarity", "web_referrer_absent_ratio", "web_uniq_paths_per_min")
#: Columns of a behavioural model leave the label and whatever the label was derived from out.
BEHAVIOUR = tuple(c for c in BOT_FEATURES if c != "bot_declared_bot" and not c.startswith("ua_"))
