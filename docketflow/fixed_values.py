"""Results depend on these being exactly as stated."""

# District courts with an active feed.
DISTRICT_COURTS = """
almd alsd akd azd ared arwd cacd cand casd cod ctd ded dcd flmd flsd gamd gud idd ilcd ilnd innd insd iand iasd
ksd kywd laed lamd lawd med mad mied miwd mnd mssd moed mowd mtd ned nvd nhd njd nmd nyed nynd nysd nced ncmd
ncwd nmid ohnd ohsd okwd ord paed pawd prd rid tned tnmd txed txsd txwd utd vtd vid vawd waed wawd wvnd wvsd wied
wiwd wyd
""".split()

# Bankruptcy courts with an active feed.
BANKRUPTCY_COURTS = """
almb alnb alsb akb azb areb cacb caeb canb casb cob ctb deb dcb flmb flnb flsb gamb ganb gasb hib ilcb ilnb ilsb
innb insb ianb iasb ksb kyeb kywb laeb lamb lawb meb mdb mab mieb miwb mnb msnb mssb moeb mtb neb nvb nhb njb nmb
nyeb nynb nysb nywb nceb ncmb ncwb ndb ohnb ohsb okeb oknb okwb orb paeb pamb pawb prb rib scb sdb tneb tnmb tnwb
txeb txnb txwb utb vtb vaeb vawb waeb wawb wvnb wvsb wieb wiwb wyb
""".split()

# Address of one court's feed.
FEED_URL = "https://ecf.{court}.uscourts.gov/cgi-bin/rss_outside.pl"

# Host that relative document addresses and archive paths belong to.
ARCHIVE_HOST = "https://www.courtlistener.com"
ARCHIVE_PREFIXES = ["/storage", "/sata"]

# Producers recorded in the prediction logs.
FEED_CLASS_TYPE = "swornot"
FEED_ENTITY_TYPE = "swobjectner"
CANDIDATE_TYPE = "candidate"
SEARCH_CLASS_TYPE = "swornot_recap"
SEARCH_ENTITY_TYPE = "swobjectner_recap"

# Words that make a docket entry a candidate.
CANDIDATE_WORDS = ["warrant", "unseal"]

NO_CATEGORY = "no category detected"
DEFAULT_LABEL = "MISC"
GENERIC_SPAN_LABEL = "OBJ"

# A case name that is exactly this text is tagged through the sentence below it.
BARE_CASE_NAME = "USA v."
BARE_CASE_SENTENCE = "Search/Seizure Warrant Returned Executed on 8/5/2020 for"

FEED_INTRO = "search warrants from PACER RSS"
SEARCH_INTRO = "search warrants from the CourtListener API"

FEED_LOOKBACK_DAYS = 1
SEARCH_LOOKBACK_DAYS = 800
SEARCH_ALERT_CAP = 500
SEARCH_PHRASE = "search warrant"
MESSAGE_BLOCKS = 46
MAX_TOKENS = 64

# Special token ids of the encoder.
PAD_ID, CLS_ID, SEP_ID = 0, 101, 102

# Sentence marker that the corpus augmentation rewrites, and its replacement.
MARKER = ("as", "to")
MARKER_REPLACEMENT = ["USA", "v."]

TRAIN_SHARE, DEV_SHARE = 0.8, 0.1

# Characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
