"""Word lists and rule tables. Fixed values, in natural order; terms that are slurs are only ever loaded from files.

A rule table's order is its meaning: the first match is the primary one.
"""

from __future__ import annotations

from dataclasses import dataclass

STRIP = ".,!?;:\"'()[]{}"

#: Words of abuse that name no group.
INSULTS = ("trash", "worthless", "scum", "idiot", "moron", "pathetic", "clown", "disgusting", "loser", "stupid")
#: Cue strength classes of the words above.
STRONG, MEDIUM, WEAK = ("scum", "worthless", "disgusting"), ("trash", "idiot", "moron", "stupid"), ("pathetic", "clown", "loser")

CATEGORIES = {
    "ability": ("idiot", "moron", "stupid"),
    "moral": ("scum", "trash", "disgusting"),
    "status": ("worthless", "pathetic", "loser", "clown"),
    "function": ("the", "and", "of", "with"),
}
EMOTIONS = {
    "anger": ("idiot", "moron", "scum", "stupid", "trash"),
    "anticipation": ("for", "to"),
    "disgust": ("disgusting", "scum", "trash", "worthless"),
    "fear": ("was", "not"),
    "joy": ("clown", "be"),
    "sadness": ("loser", "pathetic", "worthless", "not"),
    "surprise": ("clown", "that"),
    "trust": ("the", "with", "from"),
}
NEGATIVE = ("anger", "disgust", "fear", "sadness")
#: Word, valence: for the rule-based sentiment score.
VALENCE = {"trash": -1.8, "worthless": -1.9, "scum": -2.2, "idiot": -2.3, "moron": -2.2, "pathetic": -2.7, "clown": -0.5, "disgusting": -2.4, "loser": -2.4, "stupid": -2.4, "good": 1.9, "great": 3.1, "nice": 1.8, "best": 3.2}
NEGATIONS = ("not", "no", "never", "without", "nicht", "ne", "sin")
BOOSTERS = ("very", "really", "so", "in", "of")
DAMPENERS = ("slightly", "hardly", "barely", "somewhat", "a", "to")

STOPWORDS = ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "by", "as", "be", "at", "from", "this", "are", "le", "la", "les", "de", "et", "der", "die", "das", "und", "el", "los", "que", "y")
GROUP_MARKERS = ("all", "every", "always", "never", "these", "those", "them", "they", "their", "typical", "most", "majority", "the")
INDIVIDUAL_MARKERS = ("this", "that", "he", "she", "him", "her", "you", "your", "one", "it")
PRONOUNS = {
    "first_singular": ("i", "me", "my", "mine", "myself"),
    "first_plural": ("we", "us", "our", "ours", "ourselves"),
    "second": ("you", "your", "yours", "yourself"),
    "third_singular": ("he", "him", "his", "she", "her", "hers", "it", "its"),
    "third_plural": ("they", "them", "their", "theirs", "themselves"),
}
#: Stand-ins for the groups that a text may be about, by words of the synthetic languages.
TARGETS = {"EN": ("the", "of", "and"), "FR": ("les", "des", "dans"), "DE": ("der", "und", "nicht"), "ES": ("los", "que", "por")}

REFUSALS = ("i'm sorry", "i cannot", "i can't assist", "i can't help", "i am unable", "i apologize", "as an ai", "i'm not able")
PRESERVED = ("idiot", "stupid", "scum", "worthless", "trash")
GENERIC_PHRASES = ("certain people", "some people", "those people", "that person", "of the", "in the")
PLACEHOLDERS = ("certain people", "some people", "those individuals", "certain individuals", "that person")
FRAME_WORDS = ("concern", "issue", "problem", "challenge", "affect")
EXPLICIT_CUES = ("stupid", "idiot", "worthless", "scum", "moron", "trash")
#: Words that may not be followed by a given next word.
UNLESS_FOLLOWED = (("garbage", "can"), ("clown", "fish"))
VIOLENCE_PATTERNS = (r"beat[a-z]*.{0,40} to death", r"hope .{0,50}die", r"the .{0,10} of the")


@dataclass(frozen=True)
class Frame:
    """A frame's words (whole tokens) and patterns (in lower-case text; \\b is a word's bound in ASCII)."""

    name: str
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# The canonical frames, in the order that decides the primary one. Words that are slurs are added from a
# file (sources.readers.frame_terms), as are whole other versions of the table.
FRAMES = (
    Frame("DEHUMANIZATION", _words("animal animals monkey monkeys ape apes cockroach cockroaches vermin pest pests rat rats subhuman savage savages parasite parasites infestation infest plague filth scum")),
    Frame("THREAT_VIOLENCE", _words("kill killed hang gas shoot bomb nuke exterminate execute lynch murder slaughter purge cleanse eradicate eliminate burn stab genocide holocaust die death dead")),
    Frame("EXCLUSION", (), (r"\bgo back\b", r"\bdon't belong\b", r"\bnot welcome\b", r"\bget out\b", r"\bsend back\b", r"\bdeport\b", r"\bkick out\b", r"\bkeep out\b", r"\bban\b.*\bmuslim\b", r"\bbuild\b.*\bwall\b", r"\billegal alien\b")),
    Frame("CONSPIRACY", _words("control controls controlling destroy destroying invasion invade replace replacing replacement overthrow infiltrate conspire conspiracy plot scheme agenda globalist puppet brainwash propaganda takeover manipulate")),
    Frame("MORAL_DISGUST", _words("disgusting disgust filthy dirty unclean impure immoral degenerate degenerates pervert perverted abomination sick sickening vile repulsive revolting sinful unholy gross")),
    Frame("INTELLECTUAL_INFERIORITY", _words("stupid dumb idiot idiots idiotic moron morons imbecile brainless uneducated illiterate ignorant braindead clueless incompetent dense fool fools mindless")),
    Frame("SEXUAL_GENDERED", _words("rape raped raping rapist rapists breed breeding molest molested")),
    Frame("CRIMINAL_DANGER", _words("crime criminal criminals thug thugs gang gangs terrorist terrorists terrorism steal stealing theft thief thieves rob robbery illegal illegals felon pedophile pedophiles predator danger dangerous threat violent violence radical")),
    Frame("ECONOMIC_BURDEN", _words("welfare leech leeches freeloader freeloaders parasite taxpayer taxpayers burden lazy handout handouts mooch tax taxes benefits")),
    Frame("RELIGIOUS", _words("jihad jihadi sharia infidel infidels islamist heathen godless blasphemy blasphemous satanic satan antichrist crusade")),
    Frame("GENERALIZATION", (), (r"\ball\b.{0,30}\bare\b", r"\ball\b.{0,30}\bdo\b", r"\bevery\b.{0,30}\bis\b", r"\bevery\b.{0,30}\bdoes\b")),
)
# Phrases, and quantifiers and verbs, of the version of the frames that looks at sets of tokens.
EXCLUSION_PHRASES = ("go back", "get out", "dont belong", "not belong", "not welcome", "our country", "my country", "send them", "send back", "deport", "kick out", "keep out")
QUANTIFIERS, GENERAL_VERBS = ("all", "every", "always", "never"), ("are", "is", "will", "do", "can", "want", "need", "have")
# Type of an attack by the first list of which the text contains a term.
ATTACK_TYPES = (
    ("THREAT_VIOLENCE", ("kill", "die", "death", "stomp", "murder", "rape", "genocide", "exterminate", "eradicate", "annihilate", "gas", "shoot")),
    ("CONSPIRACY", ("control", "replace", "replacement", "invad", "miscegenation", "white genocide", "great replacement", "globalist")),
    ("DEHUMANIZATION", ("vermin", "cockroach", "infestation", "parasite", "subhuman", "animal", "ape", "savage", "beast")),
    ("EXCLUSION", ("send back", "don't belong", "go back", "deport", "out of our")),
    ("MORAL_DISGUST", ("immoral", "abomination", "sinful", "corrupt", "evil", "disgrace")),
    ("GENERALIZATION", ("all of them", "they always", "every single", "never")),
    ("DIRECT_INSULT", ("dumb", "stupid", "worthless", "scum", "garbage", "idiot", "moron", "pathetic", "trash")),
)
# Words of the speech acts that are found all at once, and of those of which the first counts.
COMMANDS = ("go", "get", "stop", "shut", "kill", "ban", "deport", "remove", "die", "hang", "leave")
QUESTION_WORDS = ("why", "how", "what", "when", "where", "who", "do", "does", "did", "is", "are", "can")
PAST_WORDS = ("went", "saw", "told", "said", "found", "heard", "caught", "got", "came", "happened", "tried", "started")
MOCKING_WORDS = ("lol", "lmao", "haha", "hahaha", "rofl", "imagine", "sure", "right", "wow", "oh")
FIRST_COMMANDS = ("go", "kill", "deport", "stop", "shut", "get", "leave", "take")
WISHES = ("should", "need to", "deserve", "must", "ought", "have to", "better")
FIRST_MOCKING = ("lol", "lmao", "imagine", "lmfao", "haha", "hahaha")
GENERAL_WORDS = ("all", "every", "always", "never", "most", "many")
HATE_PHRASES = ("i hate", "we hate", "hate all", "hate these")
NARRATIVE_WORDS = ("was", "were", "had", "been", "did")
#: Canonical group by the first list of which a name contains a term.
GROUPS = (
    ("chinese", ("chinese",)), ("asian", ("asian",)), ("mexican", ("mexican",)), ("latino", ("latino", "latina", "hispanic")), ("muslim", ("muslim", "islam")), ("jewish", ("jewish", "jew")),
    ("black", ("black", "african")), ("lgbtq", ("lgbtq", "lgbt", "gay", "lesbian", "queer", "bisexual", "trans")), ("women", ("women", "woman", "female")), ("middle_east", ("middle eastern", "middle-eastern", "middle east", "middle_east")),
    ("native_american", ("native american", "native-american", "indigenous", "native_american")), ("mental_dis", ("mental disab", "mental ill", "mental health", "cognitive", "mental_dis")), ("physical_dis", ("physical disab", "disab", "physical_dis")),
)
#: Pattern (case ignored), placeholder; longer phrases first.
MASKS = (("out of the", "[PHRASE]"), ("to death", "[VIOLENT_PHRASE]"), ("stupid|idiot|moron", "[ABILITY]"), ("scum|trash", "[MORAL]"), ("worthless|pathetic|loser", "[STATUS]"))
DOMAINS = ("office printers", "train delays", "garden weeds", "kitchen waste", "weather forecasts", "old software", "city traffic", "sports teams")
PREFERRED_DOMAINS = ("sports teams", "old software")
PREFERENCE_TRIGGERS = ("clown", "loser")
#: Frame, words that a domain must not hold.
DOMAIN_BLACKLIST = (("DEHUMANIZATION", ("waste", "weeds")), ("MORAL_DISGUST", ("waste",)), ("EXCLUSION", ("traffic", "train")))
SUFFIXES = ("", "s", "es", "er", "ers", "ing", "ed")
