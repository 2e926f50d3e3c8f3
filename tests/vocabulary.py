"""A small vocabulary for the tests of citations and spans."""

# Chapters (number, names, length), spellings of collections, and words around citations.
CHAPTERS = [
    (2, ["Al-Baqarah", "البقرة"], 286), (3, ["Ali 'Imran", "آل عمران"], 200), (9, ["At-Tawbah", "التوبة"], 129), (26, ["Ash-Shu'ara", "الشعراء"], 227), (49, ["Al-Hujurat", "الحجرات"], 18),
    (52, ["At-Tur", "الطور"], 49), (65, ["At-Talaq", "الطلاق"], 12), (96, ["Al-'Alaq", "العلق"], 19), (103, ["Al-'Asr", "العصر"], 3), (110, ["An-Nasr", "النصر"], 3),
]
COLLECTIONS = {
    "bukhari": ["Bukhari", "Bukhori", "al-Bukhari", "Shahih Bukhari", "البخاري"], "muslim": ["Muslim", "Sahih Muslim", "مسلم"], "ibnmajah": ["Ibn Majah", "Ibnu Majah", "ابن ماجه"],
    "riyadussalihin": ["Riyadhus Shalihin"], "abudawud": ["Abu Dawud", "Abu Daud", "أبو داود"],
}
CUES = {
    "scripture": "qs q quran koran surah surat sura ayat ayah verse firman سوره ايه الايه".split(),
    "report": "hr riwayat diriwayatkan narrated reported رواه اخرجه".split(),
    "announce": "said says prophet messenger النبي".split(),
    "said": "قال وقال يقول قوله".split(),
    "filler": "no nomor nomer number num hadith ke oleh imam by in dalam di s h r dan and".split(),
}
# Formulas around quotations.
LEADING = ["قال رسول الله", "قال النبي", "قال الله تعالي", "قال الله", "وقال", "قال"]
TRAILING = ["رواه البخاري ومسلم", "رواه البخاري", "متفق عليه", "رواه"]
GREETINGS = ["السلام عليكم ورحمه الله وبركاته"]


def tables(spark):
    names = [(n, "chapter", k, None) for k, ns, _ in CHAPTERS for n in ns] + [(n, "collection", None, c) for c, ns in COLLECTIONS.items() for n in ns]
    return spark.createDataFrame(names, "name string, kind string, chapter int, collection string"), spark.createDataFrame([(k, n) for k, _, n in CHAPTERS], "chapter int, length int")
