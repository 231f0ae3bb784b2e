"""Results depend on these entries and on their order."""

from colloquy.functions.text import SPACE, WORD

# Spoken forms and what replaces them, applied in this order as plain substrings.
SPOKEN_FORMS = (
    ("can't", "cannot"),
    ("won't", "will not"),
    ("I'm", "I am"),
    ("isn't", "is not"),
    ("aren't", "are not"),
    ("it's", "it is"),
    ("I'll", "I will"),
    ("we'll", "we will"),
    ("don't", "do not"),
    ("didn't", "did not"),
    ("ca n't", "can not"),
    ("wo not", "will not"),
    ("n't", "not"),
    ("could've", "could have"),
    ("i'm", "i am"),
    ("i've", "i have"),
    ("might've", "might have"),
    ("must've", "must have"),
    ("shan't", "shall not"),
    ("should've", "should have"),
    ("they're", "they are"),
    ("they've", "they have"),
    ("wasn't", "was not"),
    ("we're", "we are"),
    ("we've", "we have"),
    ("what're", "what are"),
    ("what've", "what have"),
    ("who're", "who are"),
    ("who've", "who have"),
    ("would've", "would have"),
    ("you're", "you are"),
    ("you've", "you have"),
    ("gonna", "going to"),
    ("gon'na", "going to"),
    ("gon na", "going to"),
    ("gotta", "got to"),
    ("wanna", "want to"),
    ("wan'na", "want to"),
    ("wan na", "want to"),
    ("hafta", "have to"),
    ("hadta", "had to"),
    ("shoulda", "should have"),
    ("woulda", "would have"),
    ("coulda", "could have"),
    ("mighta", "might have"),
    ("musta", "must have"),
    ("oughta", "ought to"),
    ("dont", "do not"),
    ("doesnt", "does not"),
    ("uh", ""),
    ("um", ""),
    ("er", ""),
    ("ah", ""),
    ("well", ""),
    ("you know", ""),
    ("I mean", ""),
    ("like", ""),
    ("hmm", ""),
)

# Patterns over a patient's lowered line and what replaces them, in this order.
PATIENT_FORMS = (
    (", you know ?", ","),
    (", you know ,", ","),
    (", you know,", ","),
    ("you know ,", ""),
    ("you know,", ""),
    (r"\bi have\b", "the patient has"),
    (r"\bi've\b", "the patient has"),
    (r"\bi am\b", "the patient is"),
    (r"\bi'm\b", "the patient is"),
    (r"\bi'd\b", "the patient would"),
    (r"\bi\b", "the patient"),
    (r"\bme\b", "the patient"),
    (r"\bmy\b", "his / her"),
)

# Size and overlap, in words, of what a punctuation model sees at once.
CHUNK_WORDS, CHUNK_OVERLAP = 230, 5
# Most mixture components, seed, membership threshold, dimension of the small-sample guard.
MOST_COMPONENTS, SEED, MEMBERSHIP, GUARD_DIMENSION = 50, 224, 0.4, 10
# The similarity from which an utterance belongs to a section; summary length in words.
SECTION_THRESHOLD, SUMMARY_MIN, SUMMARY_MAX = 0.5, 30, 130

# The end of a sentence, white space after a dot or question mark, but not after `a.b.` or `Dr.`.
BOUNDARY = rf"(?<!{WORD}\.{WORD}.)(?<![A-Z][a-z]\.)(?<=[.?]){SPACE}"

DOCTOR, PATIENT = "[doctor]", "[patient]"
