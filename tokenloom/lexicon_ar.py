"""Closed tables of the Arabic tokenizer. Root fields and analyses are parameters; a small set of roots is here."""

from __future__ import annotations

# Particles that mark a sentence.
MARKS = {
    "لا": "STR:neg:general", "لم": "STR:neg:past", "لن": "STR:neg:future", "ليس": "STR:neg:nominal", "إذا": "STR:cond:likely", "لو": "STR:cond:hypo", "لولا": "STR:cond:counter",
    "سوف": "STR:future", "هل": "STR:question", "قد": "STR:past", "لقد": "STR:emphasis", "إنّ": "STR:emphasis",
}

# Words that stand for a relation.
RELATIONS = {
    "في": "REL:in", "من": "REL:from", "إلى": "REL:to", "على": "REL:on", "عن": "REL:about", "مع": "REL:with", "بين": "REL:between", "حول": "REL:around",
    "خلال": "REL:through", "منذ": "REL:since", "حتى": "REL:until", "نحو": "REL:to", "لدى": "REL:at", "عند": "REL:at", "فوق": "REL:above", "تحت": "REL:under",
    "أمام": "REL:infront", "خلف": "REL:behind", "بعد": "REL:after", "قبل": "REL:before", "دون": "REL:without", "ضد": "REL:against", "عبر": "REL:across",
    "ضمن": "REL:within", "لأجل": "REL:for", "بما": "REL:with", "و": "REL:and", "أو": "REL:or", "ثم": "REL:then", "لكن": "REL:but", "بل": "REL:instead", "أم": "REL:or",
    "إذ": "REL:as", "كي": "REL:for", "حيث": "REL:where", "لأن": "REL:causes", "بينما": "REL:contrast", "كما": "REL:like", "مثل": "REL:like", "حين": "REL:when",
    "عندما": "REL:when", "لما": "REL:when", "لكنّ": "REL:but", "لكنه": "REL:but", "لكنها": "REL:but", "كأن": "REL:like", "كأنّ": "REL:like", "كأنه": "REL:like",
    "كأنها": "REL:like", "لعلّ": "REL:maybe", "لعله": "REL:maybe", "لعلها": "REL:maybe", "إلا": "REL:except", "سوى": "REL:except", "عدا": "REL:except",
    "خلا": "REL:except", "هذا": "REL:this", "هذه": "REL:this", "ذلك": "REL:those", "تلك": "REL:those", "الذي": "REL:which", "التي": "REL:which", "الذين": "REL:who",
    "اللذين": "REL:who", "اللاتي": "REL:who", "ما": "REL:what", "هؤلاء": "REL:these", "كل": "REL:all", "بعض": "REL:some", "أي": "REL:any", "غير": "REL:unlike",
    "كلا": "REL:both", "جميع": "REL:all", "سائر": "REL:all", "معظم": "REL:most", "أغلب": "REL:most", "عدة": "REL:several", "كثير": "REL:many", "قليل": "REL:few",
    "أكثر": "REL:more", "أحد": "REL:some", "أقل": "REL:less", "إنما": "REL:only", "إنّما": "REL:only", "أيضا": "REL:also", "أيضاً": "REL:also", "جدا": "REL:emphasis",
    "جداً": "REL:emphasis", "فقط": "REL:only", "تقريبا": "REL:almost", "تقريباً": "REL:almost", "حاليا": "REL:now", "حالياً": "REL:now",
}

# Words that stay literals.
LITERALS = [
    "هو", "هي", "هم", "هن", "أنا", "نحن", "أنت", "أنتم", "أنتِ", "أنتن", "أنتنّ", "هما", "نفس", "ذات", "إن", "أن", "أنّ", "لعل", "يا",
]

# Numerals.
NUMERALS = ["واحد", "اثنان", "ثلاثة", "أربعة", "خمسة", "ستة", "سبعة", "ثمانية", "تسعة", "عشرة", "عشر", "مئة", "مائة", "ألف", "مليون", "ثلث"]

# Months.
MONTHS = {
    "يناير": "jan", "فبراير": "feb", "شباط": "feb", "مارس": "mar", "آذار": "mar", "أبريل": "apr", "نيسان": "apr", "مايو": "may", "أيار": "may", "يونيو": "jun", "حزيران": "jun",
    "يوليو": "jul", "تموز": "jul", "أغسطس": "aug", "آب": "aug", "سبتمبر": "sep", "أيلول": "sep", "أكتوبر": "oct", "نوفمبر": "nov", "ديسمبر": "dec",
}

# Words that are told by themselves where missed roots are counted.
FUNCTION_WORDS = [
    "في", "من", "إلى", "على", "عن", "مع", "بين", "حول", "خلال", "منذ", "حتى", "نحو", "لدى", "عند", "فوق", "تحت", "أمام", "خلف", "بعد", "قبل", "دون", "ضد",
    "عبر", "ضمن", "لأجل", "و", "أو", "ثم", "لكن", "بل", "أم", "إذا", "لو", "إذ", "كي", "حيث", "لأن", "بينما", "كما", "مثل", "حين", "عندما", "لما", "هو",
    "هي", "هم", "هن", "أنا", "نحن", "أنت", "أنتم", "هذا", "هذه", "ذلك", "تلك", "الذي", "التي", "الذين", "اللذين", "اللاتي", "ما", "هؤلاء", "كل", "بعض", "أي", "غير",
    "كلا", "أحد", "جميع", "سائر", "معظم", "أغلب", "عدة", "كثير", "قليل", "نفس", "ذات", "أكثر", "لا", "لم", "لن", "ليس", "كان", "يكون", "أصبح", "ظل", "بات", "صار",
    "قد", "سوف", "لقد", "إن", "أن", "إنّ", "لعل", "أنّ", "واحد", "اثنان", "ثلاثة", "أربعة", "خمسة", "ستة", "سبعة", "ثمانية", "تسعة", "عشرة", "عشر", "مئة", "مائة", "ألف",
    "مليون", "أيضا", "أيضاً", "جدا", "جداً", "فقط", "تقريبا", "تقريباً", "حاليا", "حالياً", "بما", "ثلث",
]

# Proclitics, in the order in which words are tried without them.
PROCLITICS = ["وال", "وب", "ول", "وك", "فال", "فب", "فل", "ال", "لل", "بال", "كال"]

# Patterns without short vowels, with their roles.
PATTERNS = {
    "1ا23": "agent", "1ا23ة": "agent", "1ا23ه": "agent", "1ا23ات": "agent", "1ا23ون": "agent", "1ا23ين": "agent", "م12و3": "patient", "م12و3ة": "patient", "م12و3ه": "patient",
    "م123ة": "place", "م123ه": "place", "م12ّ3ة": "place", "م12ّ3ه": "place", "م12ا3": "place", "12ا3": "instance", "12و3": "instance", "12ّا3": "instance", "12ا3ة": "state", "12ا3ه": "state",
    "ت12ي3": "instance", "ان12ا3": "instance", "ا1ت2ا3": "instance", "است12ا3": "instance", "ت1ا23": "mutual", "م1ا23ة": "process", "م1ا23ه": "process", "م12ّ3": "causer", "مست123": "seeker",
    "12ي3": "quality", "12ي3ة": "quality", "12ي3ه": "quality", "123ان": "quality", "123ى": "quality",
}

# Roles of parts of speech.
POS_ROLES = {"adj": "quality", "adj_comp": "quality", "adj_num": "quality"}
# Roles of a root with a pattern.
ROOT_PATTERN_ROLES = {("ش.ف.ي", "مست123"): "place"}
# What stands for no root.
NO_ROOTS = ["NTWS", "PUNC", "DIGIT", "FOREIGN"]

# Clitics by slot, in reading order.
CLITICS = {
    "prc2": {"wa_conj": ["REL:and"], "wa_part": ["REL:and"], "wa_sub": ["REL:and"], "fa_conj": ["REL:then"], "fa_conn": ["REL:then"], "fa_rc": ["REL:then"], "fa_sub": ["REL:then"]},
    "prc1": {
        "bi_prep": ["REL:with"], "bi_part": ["REL:with"], "li_prep": ["REL:for"], "li_jus": ["REL:for"], "li_sub": ["REL:for"], "libi_prep": ["REL:for", "REL:with"], "la_prep": ["REL:for"],
        "la_emph": ["STR:emphasis"], "ka_prep": ["REL:like"], "sa_fut": ["STR:future"], "Ha_fut": ["STR:future"], "laHa_emphfut": ["STR:emphasis", "STR:future"], "laHa_rcfut": ["STR:future"],
        "min_prep": ["REL:from"], "fiy_prep": ["REL:in"], "Ea_prep": ["REL:about"], "EalaY_prep": ["REL:on"], "ta_prep": ["REL:by"], "wa_prep": ["REL:with"], "hA_dem": ["REL:this"], "<i$_interrog": ["STR:question"],
    },
    "prc0": {"Al_det": ["FEAT:def"], "AlmA_neg": ["FEAT:def", "STR:neg:general"], "mA_neg": ["STR:neg:general"], "ma_neg": ["STR:neg:general"], "lA_neg": ["STR:neg:general"]},
    "prc3": {">a_ques": ["STR:question"]},
}

# Persons.
PERSONS = ["1s", "1p", "2d", "2p", "2ms", "2fs", "2mp", "2fp", "3d", "3p", "3ms", "3fs", "3mp", "3fp"]

# Fixed value: letters that a weak place # may stand for, in order.
WEAK = ["و", "ي", "ا", "ء", "ى"]

# A few roots of our own choice.
ROOTS = {
    "ك.ت.ب": "write", "ق.ر.ء": "know", "ع.ل.م": "know", "د.ر.س": "know", "ذ.ه.ب": "move", "ر.س.ل": "send", "ك.و.ن": "exist", "ق.و.ل": "speak", "ب.ن.ي": "make",
    "ف.ت.ح": "open", "ح.ك.م": "govern", "أ.ك.ل": "food", "ب.ي.ت": "dwell", "ط.ل.ب": "want", "ح.ر.ب": "fight", "ك.ب.ر": "size", "و.ق.ت": "time",
}
FIELDS = "root pattern pos lex prc0 prc1 prc2 prc3 enc0 asp per gen num".split()

# Fields in the order in which a gloss is searched for their names.
GLOSS_FIELDS = [
    "write", "know", "speak", "think", "see", "feel", "move", "give", "take",
    "make", "destroy", "change", "exist", "time", "place", "possess", "trade",
    "fight", "enable", "govern", "create", "force", "body", "food", "nature",
    "weather", "animal", "plant", "color", "size", "measure", "connect",
    "contain", "open", "hold", "hide", "gather", "send", "social", "dwell",
    "need", "want", "decide", "fix", "rest", "person", "name", "art",
    "science", "tech", "material", "structure", "quality", "sport", "work",
]
# Fields of an entry's domain.
DOMAIN_FIELDS = {
    "communication": "speak", "cognition": "know", "creation": "create", "transformation": "change", "movement": "move", "perception": "see", "possession": "possess", "social": "social",
    "abstract": "think", "body": "body", "health": "body", "character": "quality", "culture": "art", "economy": "trade", "food": "food", "home": "dwell", "governance": "govern",
    "nature": "nature", "physical": "material", "relations": "connect", "science": "science",
}
