"""Tone and headline tables of the domain. All of this module is fixed values."""

from __future__ import annotations

# Words and phrases with their tone.
BULLISH = {
    "moon": 2.0, "mooning": 2.2, "moonshot": 1.8, "bullish": 2.0, "bull": 1.4, "pump": 1.6, "pumping": 1.8, "pumped": 1.2, "long": 1.0, "longing": 1.2,
    "buy": 1.2, "buying": 1.3, "bought": 0.9, "accumulate": 1.4, "accumulating": 1.4, "hodl": 1.5, "hodling": 1.5, "breakout": 1.8, "rally": 1.7, "rallying": 1.8,
    "surge": 1.8, "surging": 1.9, "ath": 1.6, "gains": 1.2, "green": 1.0, "ripping": 1.7, "lambo": 1.5, "printing": 1.4, "undervalued": 1.6, "oversold": 1.2,
    "bottomed": 1.3, "reversal": 0.9, "adoption": 1.3, "partnership": 1.4, "upgrade": 1.2, "listing": 1.5, "institutional": 1.1, "squeeze": 1.3, "lfg": 1.8, "wagmi": 1.7,
    "gem": 1.5, "parabolic": 2.0, "exploding": 1.7, "sending": 1.4, "10x": 1.8, "100x": 2.0, "diamond": 1.2, "based": 0.8, "alpha": 0.9, "golden cross": 1.9,
    "cup and handle": 1.3, "higher low": 1.2, "jumps": 1.3, "soars": 1.7, "climbs": 1.1, "spikes": 1.3, "inflows": 1.2, "record high": 1.6, "outperform": 1.2, "recovers": 1.0,
}
BEARISH = {
    "dump": -1.7, "dumping": -1.9, "dumped": -1.4, "bearish": -2.0, "bear": -1.3, "crash": -2.1, "crashing": -2.2, "rug": -2.4, "rugpull": -2.6, "rugged": -2.4,
    "scam": -2.3, "ponzi": -2.4, "short": -1.2, "shorting": -1.4, "sell": -1.2, "selling": -1.3, "sold": -1.0, "dead": -1.8, "dying": -1.7, "rekt": -2.0,
    "liquidated": -2.0, "liquidation": -1.6, "bleeding": -1.7, "red": -1.0, "tanking": -1.9, "collapse": -2.1, "collapsing": -2.2, "capitulation": -1.8, "overvalued": -1.5, "overbought": -1.1,
    "topped": -1.3, "death cross": -1.9, "hack": -2.2, "hacked": -2.4, "exploit": -2.1, "exploited": -2.3, "delisted": -2.3, "lawsuit": -1.8, "fud": -0.9, "bagholder": -1.6,
    "bags": -1.0, "ngmi": -1.7, "worthless": -2.2, "avoid": -1.4, "plummet": -2.0, "plunging": -2.0, "lower high": -1.2, "paper hands": -1.0, "exit liquidity": -2.0, "drops": -1.3,
    "falls": -1.3, "slips": -1.1, "slides": -1.2, "tumbles": -1.6, "sinks": -1.5, "retreats": -1.0, "outflows": -1.3, "plunges": -1.8, "sell-off": -1.7, "selloff": -1.7,
    "headwinds": -1.1, "weigh on": -1.2, "struggles": -1.2, "stalls": -1.1, "falling": -1.2, "fell": -1.2, "declining": -1.3, "decline": -1.2, "fails": -1.2,
}
LEXICON = BULLISH | BEARISH
# Emoji with their tone, of which no more than EMOJI_MOST each count in a text.
EMOJI = {"🚀": 2.0, "🌙": 1.6, "📈": 1.3, "💎": 1.3, "🙌": 0.8, "🐂": 1.4, "🤑": 1.2, "💰": 0.9, "📉": -1.4, "🐻": -1.5, "💀": -1.6, "🩸": -1.5, "🤡": -1.4, "⚰️": -1.7}
EMOJI_MOST = 4
# Words that turn what follows, and words that strengthen it.
NEGATORS = (
    "not", "no", "never", "isnt", "isn't", "wasnt", "wasn't", "dont", "don't", "doesnt", "doesn't", "didnt", "didn't", "wont", "won't",
    "cant", "can't", "cannot", "aint", "ain't", "without", "hardly", "barely", "stop", "stopped", "avoid",
)
INTENSIFIERS = {"very": 1.4, "super": 1.4, "extremely": 1.6, "massively": 1.6, "huge": 1.4, "insane": 1.5, "absolutely": 1.4, "so": 1.15, "really": 1.2, "fucking": 1.4, "literally": 1.1}

# Kinds of headlines in the order in which they are looked for, with pattern, impact, direction, and whether the tone decides the direction.
HEADLINES = (
    ("exploit", r"exploit(ed)?|drained|vulnerabilit(y|ies)", 0.95, -1, False),
    ("hack", r"hack(ed|s)?|breach(ed)?|stolen funds", 0.95, -1, False),
    ("depeg", r"de-?peg(ged)?|lost (its )?peg", 0.80, -1, False),
    ("etf", r"etfs?|exchange[- ]traded funds?", 0.95, 1, True),
    ("delisting", r"delist(ed|ing)?|removed from", 0.85, -1, False),
    ("lawsuit", r"(lawsuit|sue[sd]?|suing|court|settlement|indict)[a-z0-9_]*", 0.75, -1, False),
    ("regulation", r"sec|cftc|regulat(or|ory|ion)|ban(ned|s)?|crackdown|subpoena", 0.60, -1, True),
    ("token_unlock", r"unlock(s|ed|ing)?|vesting|cliff|token release|emission", 0.70, -1, False),
    ("outage", r"outage|halt(ed|s)?|downtime|stall(ed)?|degraded", 0.65, -1, False),
    ("halving", r"halv(ing|ed)", 0.80, 1, False),
    ("hard_fork", r"hard ?fork|soft ?fork|fork", 0.70, 1, False),
    ("mainnet", r"mainnet|genesis launch|go[- ]live", 0.75, 1, False),
    ("upgrade", r"upgrade|hardfork|migration|v[0-9]+([.][0-9]+)?[ \t\n]+launch|protocol update", 0.60, 1, False),
    ("listing", r"list(ed|ing)? on|new listing|debut(s)? on|now trading on", 0.70, 1, True),
    ("institutional", r"institutional|blackrock|fidelity|grayscale|treasury|custody", 0.60, 1, True),
    ("partnership", r"partner(ship|s|ed)?|collaborat|integrat(es|ion|ed)", 0.50, 1, True),
    ("airdrop", r"air ?drop", 0.55, 1, False),
    ("burn", r"burn(s|ed|ing)?|deflationary", 0.50, 1, False),
    ("buyback", r"buy ?back|repurchase", 0.60, 1, False),
    ("staking", r"stak(e|es|ing)|validator|restaking", 0.45, 1, True),
    ("testnet", r"testnet|devnet|beta release", 0.35, 1, False),
    ("audit", r"audit(ed|s)?|formal verification", 0.30, 1, False),
    ("delay", r"delay(ed|s)?|postpone[ds]?|push(ed)? back", 0.45, -1, False),
)
AHEAD = (
    r"(will|upcoming|scheduled|slated|expected|set to|plans? to|to launch|ahead of|next (week|month|monday|tuesday|wednesday|thursday|friday)|"
    r"in (the coming|coming) (days|weeks)|q[1-4][ \t\n]?20[0-9][0-9]|on (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
)
DENIED = r"denie[sd]|reject(ed|s)?|rumou?r|unconfirmed|speculation|no plans|dismisse[sd]|false"
# Half-lives of news in days, ahead of the event and not; of a release; and what a release before the final one is worth.
HALF_LIFE = {"ahead": 6.0, "news": 1.5, "release": 14.0}
PRERELEASE = 0.6


def word(pattern: str, whole: bool = True) -> str:
    """pattern between places where no ASCII letter, digit or underscore goes on; at its start only, if not whole."""
    return f"(^|[^a-z0-9_])({pattern})" + ("([^a-z0-9_]|$)" if whole else "")
