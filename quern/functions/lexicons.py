"""Word lists and patterns that routing, tokenizing and enrichment use.

All of them are defaults: every function that uses one takes it as a parameter, and names of an
institution belong in those parameters.
"""

# ruff: noqa: RUF001

# Results depend on these lists and their order.

#: Dialect word or phrase to standard form, applied in this order.
DIALECT = {
    "ازيك": "كيف حالك",
    "ازيكم": "كيف حالكم",
    "عامل ايه": "كيف حالك",
    "عاملة ايه": "كيف حالك",
    "ايه الاخبار": "ما الأخبار",
    "ايه احوالك": "كيف حالك",
    "هاي": "مرحباً",
    "هاى": "مرحباً",
    "هلو": "مرحباً",
    "مصاريف": "رسوم دراسية",
    "فلوس": "أموال",
    "كام": "كم",
    "بكام": "بكم",
    "امتى": "متى",
    "فين": "أين",
    "ازاي": "كيف",
    "ليه": "لماذا",
    "ايه": "ما",
    "إيه": "ما",
    "مش": "لا / ليس",
    "مش عارف": "لا أعرف",
    "مش فاهم": "لا أفهم",
    "عايز": "أريد",
    "عايزة": "أريد",
    "عوزين": "نريد",
    "بيقولوا": "يقولون",
    "بتقولوا": "تقولون",
    "ممكن": "هل يمكن",
    "محتاج": "أحتاج",
    "محتاجة": "أحتاج",
    "لو سمحت": "من فضلك",
    "لو سمحتي": "من فضلك",
    "شكراً": "شكراً",
    "شكرا": "شكراً",
    "متشكر": "شكراً",
    "تمام": "موافق",
    "ماشي": "موافق",
    "اوكي": "موافق",
    "اوكى": "موافق",
    "يعني": "أي أن",
    "بس": "لكن / فقط",
    "زي": "مثل",
    "زى": "مثل",
    "كتير": "كثير",
    "أوي": "جداً",
    "قوي": "جداً",
    "برضو": "أيضاً",
    "برضه": "أيضاً",
    "دلوقتي": "الآن",
    "دلوقت": "الآن",
    "هنا": "هنا",
    "هناك": "هناك",
    "هناه": "هناك",
    "كلية الطب بشري": "كلية الطب البشري",
    "دكتوراة": "دكتوراه",
    "ادخال": "قبول",
    "انتساب": "التحاق",
    "مدخل": "مقبول",
    "اتقبلت": "قُبلت",
}

#: Presentation forms of letters and the plain letters.
SHAPES = {"ﺔ": "ة", "ﻟ": "ل", "ﺎ": "ا"}

#: Greetings; those of up to four letters count as whole words only.
GREETINGS = (
    "hi", "hello", "hey", "good morning", "good evening", "good afternoon", "مرحبا", "مرحباً", "السلام عليكم", "اهلا", "أهلاً", "أهلا", "هلا",
    "صباح الخير", "مساء الخير", "صباح النور", "مساء النور", "هاي", "هلو", "ازيك", "ازيكم", "عامل ايه", "كيف حالك",
)

#: Asking for English; tried before the next list.
SWITCH_TO_EN = (
    r'\bin english\b', r'\banswer in english\b', r'\brespond in english\b', r'\btranslate to english\b', r'\btranslate it\b', "بالانجليزي",
    "بالإنجليزي", "بالإنجليزية", "باللغة الانجليزية", "باللغة الإنجليزية", "جاوب بالانجليزي", "جاوب باللغة الانجليزية", "رد بالانجليزي",
    "رد باللغة الانجليزية", "قولي بالانجليزي", r'ترجمه?\s*(ل|بال)?\s*انجليزي', r'ترجم\s*(ل)?\s*انجليزي', r'ترجم\s*(ل)?\s*الانجليزية',
    r'ترجم\s*(ل)?\s*الإنجليزية', r'قوله?\s*بالانجليزي', "بالانجش", "english please", "say it in english",
)

#: Asking for Arabic.
SWITCH_TO_AR = (
    r'\bin arabic\b', r'\banswer in arabic\b', r'\brespond in arabic\b', r'\btranslate to arabic\b', "بالعربي", "بالعربية", "باللغة العربية",
    "جاوب بالعربي", "جاوب باللغة العربية", "رد بالعربي", "رد باللغة العربية", r'ترجم\s*(ل)?\s*عربي', r'ترجم\s*(ل)?\s*العربية',
)

#: Words of an acknowledgment.
ACKNOWLEDGMENTS = (
    "طيب", "حاضر", "ماشي", "تمام", "أوكي", "اوكي", "اوكى", "أوكى", "حسنا", "حسناً", "نعم", "آه", "أيوه", "ايوه", "يلا", "هيا", "شكرا", "شكراً",
    "متشكر", "ممتاز", "كويس", "تسلم", "صح", "مظبوط", "عال", "عاش", "برافو", "جميل", "رائع", "عظيم", "معلش", "يعني", "بس", "اه", "اوه", "واو", "مش",
    "فاهم", "فاهمة", "واضح", "مفهوم", "عارف", "عارفة", "ok", "okay", "sure", "yes", "yep", "yeah", "alright", "fine", "thanks", "thank", "you",
    "noted", "understood", "cool", "great", "nice", "good", "right", "perfect", "awesome", "wow", "oh", "ah", "i", "see", "got", "it",
)

#: Topic words looked for in the message as it is.
KEYWORDS_AR = (
    "جامعة", "كلية", "مصاريف", "رسوم", "تكاليف", "قبول", "تقديم", "تسجيل", "تنسيق", "شروط", "منحة", "خصم", "دراسة", "برنامج", "تخصص", "ساعات", "طب",
    "هندسة", "حاسب", "اقتصاد", "فنون", "طاقة", "بيطري", "علاج", "امتياز", "درجات", "مجموع", "ثانوية", "ألف", "دولار", "جنيه", "سكن", "نقل", "تأمين",
    "اعتماد", "معادلة", "وافد", "وافدين", "مصري", "رابط", "موقع", "فيسبوك", "التقديم", "مستندات", "سياسة", "سحب", "استرداد", "تدريب", "مستشفى",
    "متطلبات", "الالتحاق", "التحاق", "طلاب", "الطلاب", "دولي", "أجنبي", "التسجيل", "القبول", "الدراسة", "الرسوم", "المصاريف", "التخصص", "مدة",
    "سنوات", "فصل", "ترم", "اكاديمي", "أكاديمي", "دبلوم", "IG", "IGCSE", "SAT", "EST", "ACT", "STEM", "GPA", "IB", "AP", "TOEFL", "IELTS",
    "transcript", "prerequisite", "elective", "syllabus", "اختصار", "معناه", "ما معنى", "ما هو", "عايز ادخل", "عايز اتقدم", "محتاج", "ايه الكليات",
    "ايه المصاريف", "اشتغل", "مستقبل", "تخرج", "شهادة", "اعتراف",
)

#: Topic words looked for in lower case.
KEYWORDS_EN = (
    "university", "college", "faculty", "fees", "tuition", "cost", "price", "admission", "apply", "application", "register", "enrollment", "accept",
    "scholarship", "discount", "grant", "program", "major", "degree", "medicine", "engineering", "computer", "science", "economics", "arts", "energy",
    "veterinary", "therapy", "dentistry", "pharmacy", "minimum", "gpa", "grade", "score", "igcse", "sat", "est", "act", "housing", "transport",
    "insurance", "accreditation", "link", "website", "facebook", "document", "refund", "training", "hospital", "internship", "graduate",
    "certificate", "toefl", "ielts", "ib", "transcript", "prerequisite", "elective", "abbreviation", "what does", "what is", "meaning of",
)

#: Patterns of other topics.
OUT_OF_SCOPE = (
    "(weather|طقس|حالة الجو)", "(recipe|وصفة|طبخ|اطبخ)", r'(football|soccer|كرة\s*ال?قدم|الكورة|كورة|مباراة|ليفربول|الأهلي|الزمالك|بتشجع|بيشجع)',
    "(movie|film|فيلم|مسلسل|نتفليكس|cinema)", r'\bjoke\b|نكتة', "(stock market|بورصة)", "(احسب|جدول ضرب|معادلة رياضية|calculate|math problem)",
    "(اكتبلي كود|اكتب كود|برمجلي|write.*code|python code|javascript code)", r'(اعمل قصيدة|اكتبلي قصة|قصيدة|poem\b|write.*story)',
    "(dating|علاقة عاطفية|حبيب|حبيبة)", r'(politics|سياسة|حكومة|رئيس\s+جمهورية)', "(religion|دين|فتوى)",
    "(بيتزا|برجر|برغر|كشري|فول|طعمية|شاورما|سندوتش|مطعم|وجبة|pizza|burger|food|restaurant)",
    r'(ما\s*را?يك\s+ف[ي|ى]|را?يك\s+ف[ي|ى]|بتحب\s+ايه|بتحب\s+إيه|تحب\s+ايه)',
)

#: Patterns of offensive messages.
OFFENSIVE = (
    r'(خرا|زبالة|كلب\b|حمار\b|غبي|احمق|عبيط|منيك|كس\b|طيز|نيك\b|لعنة)', r'\b(fuck|shit|bitch|ass\b|damn\b|crap\b|idiot|stupid\b|dumb\b)',
)

#: Patterns of messages in distress.
CRISIS = (
    "(عايز اموت|عايزة اموت|اموت|انتحار|اقتل نفسي|مش عارف اعيش|تعبت من الحياة|مش قادر اكمل)",
    r"\b(want to die|kill myself|suicide|end my life|cant go on|can't go on)\b",
)

#: Patterns of questions.
QUESTIONS = (
    "[?؟]", "^(ما|ماذا|من|كيف|كيفية|هل|متى|أين|لماذا|كم|ماهي|ماهو)", r'^(what|how|when|where|why|who|can|is|are|do|does)\b',
    r'\b(ايه|فين|امتى|ازاي|ليه|كام|مين|إيه)\b', "^(اخبرني|اخبر|وضح|اشرح|عرف|قولي|ممكن|محتاج)",
)

#: Arabic stop words.
STOP_AR = (
    "في", "من", "إلى", "على", "عن", "مع", "هذا", "هذه", "التي", "الذي", "وفي", "وعلى", "ومن", "أو", "لا", "ما", "كان", "يكون", "هو", "هي", "به",
    "لها", "له", "لهم", "بها", "بهم", "كما", "حيث", "إذ", "عند", "كل", "بعض", "غير", "حتى", "إن", "أن", "عبر", "وهو", "وهي",
)

#: English stop words.
STOP_EN = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "can", "could", "should", "may", "might", "shall",
)

#: Patterns of each section; ties go to the first.
SECTIONS = {
    "fees": ("مصاريف", "رسوم", "تكاليف", "fees", "tuition", "ألف", "دولار", "تخفيض", "منحة", "خصم", "استرداد",),
    "admission": ("قبول", "التحاق", "تسجيل", "شروط", "قيد", "تقديم", "admission", "apply", "enrollment", "register", "تنسيق", "مفاضلة", "مستندات",),
    "faculties": ("كلية", "برنامج", "أقسام", "faculty", "college", "program", "هندسة", "طب", "حاسب", "اقتصاد", "فنون", "طاقة", "ساعة معتمدة", "سنين الدراسة",),
    "links": ("رابط", "موقع", "link", "url", "http", "www", "تواصل", "فيسبوك", "facebook",),
    "scholarships": ("منح", "خصم", "تفوق", "scholarship", "discount", "شهداء", "ذوي الهمم", "إعاقة",),
    "general": (),
}

#: Cells that stand for the value above.
PLACEHOLDERS = ("—", "–", "-", "---", "", "/", "ـ")

#: Words of a header whose column names the row.
NAME_COLUMNS = ("اسم", "كلية", "برنامج", "name", "faculty", "program", "الكلية", "البرنامج")

#: Words in a file name that tell its kind, and the label.
LABELS = (
    (("facult", "ملف", "تعريف", "information"), "الملف التعريفي للكليات (Faculties & Fees)"),
    (("faq", "question", "سؤال", "شائع", "نهائي"), "الأسئلة الشائعة (FAQ)"),
    (("screenshot", "screen", "policy", "سياس", "قبول", "admission", "chatbot"), "سياسات القبول (Admission Policies)"),
)
