"""Fixed values of the text measurement: pattern lists, stop words and screens."""

from __future__ import annotations

# Fixed values. Order matters: the alternatives of one construct are tried from
# left to right.
PATTERNS: dict[str, tuple[str, ...]] = {
    "ATT": (
        "wonderful", "lovely", "amazing", "fantastic", "excellent", "delightful", "charming",
        "beautiful", "gorgeous", "stunning", "comfortable", "cosy", "cozy", "relaxing", "peaceful",
        "enjoyable", "enjoyed", "pleasant", "great (?:stay|place|time|experience|apartment|host)",
        "loved (?:the|it|our|this|staying)", "we love", "i love", "worthwhile",
        "worth (?:it|every|the)", "good value", "value for money", "nicely decorated", "tastefully",
        "spotless", "immaculate", "well[- ]appointed", "homely", "home away from home", "memorable",
        "magical", "superb", "outstanding", "terrific",
    ),
    "SN": (
        "recommend", "recommended", "recommendation",
        "my (?:friends?|family|wife|husband|partner|colleagues?|parents)",
        "our (?:friends?|family|group|colleagues?)",
        "(?:friends?|family) (?:told|said|suggested|recommended)", "told (?:us|me) (?:about|to)",
        "as (?:other|previous) reviews?", "other (?:guests?|reviewers?|travell?ers?)",
        "the reviews? (?:were|are|said)", "read the reviews?", "word of mouth",
        "everyone (?:said|told|loved|agreed)", "popular (?:with|among|choice)", "well[- ]reviewed",
        "highly rated", "heard (?:about|from)", "suggested by", "would tell",
        "tell (?:my|our|your) friends",
    ),
    "PBC": (
        "easy", "easily", "effortless", "convenient", "convenience", "hassle[- ]free",
        "stress[- ]free", "smooth", "seamless", "straightforward",
        "simple (?:to|check|process|booking)", "no (?:problem|issues?|trouble|difficulty|hassle)",
        "self check[- ]?in", "check[- ]?in was", "flexible", "flexibility",
        "quick(?:ly)? (?:respond|replied|answered|response)", "responsive", "prompt(?:ly)?",
        "always (?:available|reachable)", "walking distance", "well connected",
        "close to (?:everything|the)", "accessible", "easy access", "clear instructions",
        "detailed instructions", "communication was", "communicative", "got in touch",
        "sorted (?:it|everything) out", "in control", "we could", "we were able to", "allowed us to",
    ),
    "BI": (
        "(?:will|would|shall) (?:definitely |certainly |absolutely )?"
        "(?:be )?(?:return|come back|stay again|book again|be back|revisit)",
        "(?:we|i)(?:'| a)?(?:ll| will| would)? (?:be )?(?:back|returning)",
        "come back", "coming back", "stay (?:here )?again", "book again", "booking again",
        "next (?:time|visit|trip|stay)", "hope to (?:return|come back|stay|visit)",
        "look(?:ing)? forward to (?:return|coming|staying|our next)",
        "can'?t wait to (?:return|come back|stay)", "plan(?:ning)? to (?:return|come back|stay again)",
        "first of many", "definitely stay", "our go[- ]to", "would love to (?:return|come back|stay)",
    ),
    "SAT": (
        "satisfied", "satisfaction", "happy with", "very happy", "pleased", "delighted with",
        "exceeded (?:our |my )?expectations?", "met (?:our|my|all) expectations?", "lived up to",
        "as (?:described|advertised|expected|pictured)", "exactly (?:as|what|like)",
        "no complaints?", "nothing (?:to|but)", "perfect (?:stay|for|place|location|apartment)",
        "couldn'?t (?:be|have)", "thoroughly enjoyed", "worth every (?:penny|cent|euro|dollar)",
        "great experience", "we were (?:very )?(?:happy|pleased|impressed)", "impressed",
        "first[- ]class", "top notch", "5 stars?", "five stars?",
    ),
}

# Fixed values.
STOP_WORDS: tuple[str, ...] = (
    "the", "and", "was", "were", "is", "are", "we", "our", "us", "it", "its", "this", "that",
    "there", "here", "with", "for", "very", "had", "have", "has", "would", "will", "not", "but",
    "you", "your", "they", "their", "from", "all", "also", "just", "his", "her", "she", "he",
    "been", "of", "in", "on", "at", "to", "a", "an", "as",
)

# Fixed values.
AUTOMATED_POSTS: tuple[str, ...] = (
    "this is an automated posting",
    "the host canceled this reservation",
    "the reservation was canceled",
)

# Screens and lengths.
MIN_CHARS = 100
MIN_TOKENS = 15
MIN_STOP_WORDS = 3
LANGUAGE_TOKENS = 80
STORED_CHARS = 4000
SENTIMENT_CHARS = 1500

# Display names.
CONSTRUCT_LABELS = {
    "ATT": "Attitude (ATT)",
    "SN": "Subjective norm (SN)",
    "PBC": "Perceived behavioural control (PBC)",
    "BI": "Revisit intention (BI)",
    "SAT": "Satisfaction (SAT)",
}

# Default valences of the sentiment rule; pass your own for real work.
VALENCES: dict[str, float] = {
    "amazing": 2.8, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "comfortable": 1.5, "dirty": -1.9,
    "easy": 1.9, "excellent": 2.7, "exceeded": 1.2, "friends": 2.1, "good": 1.9, "great": 3.1,
    "hope": 1.9, "horrible": -2.5, "loved": 2.9, "lovely": 2.8, "noisy": -0.7, "perfect": 2.7,
    "poor": -2.1, "problem": -1.7, "recommended": 0.8, "smooth": 0.9, "terrible": -2.1,
    "uneasy": -1.6, "wonderful": 2.7, "complaints": -1.7,
}
NEGATORS: tuple[str, ...] = ("no", "not", "never", "without", "cannot", "isn't", "wasn't", "didn't")


def joined(patterns: tuple[str, ...]) -> str:
    """One regular expression that tries the patterns in order."""
    return "|".join(f"(?:{p})" for p in patterns)
