"""Word lists, patterns and thresholds."""

# Results depend on exactly these.
PLACEHOLDER = r"(?i)<(?:URL|USER|EMAIL|SOURCE|ENGAGEMENT)>"
TURKISH_LETTERS = "A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû"
URL = r"(?iU)https?://\S+|www\.\S+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MENTION = r"(?U)(?<!\w)@[A-Za-z0-9_]+"
HASHTAG = r"(?U)(?<!\w)#([^\s#]+)"
NUMBER = r"(?U)\d+(?:[.,:/-]\d+)*"
SOURCE_BRAND = r"(?iU)\b(?:teyit(?:\.org)?|doğruluk\s+payı|dogrulukpayi\.com|doğrula(?:\.org)?|malumatfuruş|trt\s+haber|anadolu\s+ajansı)\b"
CLAIM_BRAND = r"(?iU)\b(?:teyit(?:\.org)?|doğruluk\s+payı|doğrula(?:\.org)?|malumatfuruş)\b"
AGENCY_SIGNATURE = r"(?mU)(?:^|\n)\s*(?:[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜa-zçğıöşü/-]*(?:\s+[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜa-zçğıöşü/-]*)*)\s*\((?:AA|DHA|İHA)\)\s*[-–—:]\s*"
AGENCY_NEWS = r"(?iU)\bAA(?:'nın|’nın|nın)?\s+haberine\s+göre\b"
ENGAGEMENT = r"(?iU)\b\d[\d.,]*\s*(?:beğeni|retweet|görüntülenme|takipçi)(?:\s+sayısı)?\b"
REPORTER = (
    (r"(?iU)\b(?:AA|TRT\s+Haber)\s+muhabirine\b", "muhabire"),
    (r"(?iU)\b(?:AA|TRT\s+Haber)\s+muhabirinin\b", "muhabirin"),
    (r"(?iU)\b(?:AA|TRT\s+Haber)\s+muhabiri\b", "muhabir"),
)
SOCIAL_CLAIM = (
    (r"(?iU)\bsosyal\s+medyada\s+(?:paylaşılan|yayılan|yer\s+alan|dolaşıma\s+giren)\s+iddiaya\s+göre\b", "bir sosyal medya iddiasına göre"),
    (r"(?iU)\bsosyal\s+medyada\s+(?:paylaşılan|yayılan|yer\s+alan|dolaşıma\s+giren)\s+(bir\s+)?(iddia|video|fotoğraf|görüntü|paylaşım)\b", "sosyal medyadaki $1$2"),
)
CLAIM_STATEMENT = (
    (r"(?iU)\biddia\s+edildi\b", "iddia olarak aktarıldı"),
    (r"(?iU)\biddia\s+ediliyor\b", "iddia olarak aktarılıyor"),
    (r"(?iU)\biddia\s+edilmiş\b", "iddia olarak aktarılmış"),
)
HEADING = r"(?imU)(?:^|\n)\s*(?:analiz|bulgularımız|bulgular)\s*:?\s*"
VERIFICATION = r"(?iU)\b(?:teyit\s+sonucu|teyit\s+edildi|teyit\s+edilemedi)\b"
REPORT_HEADING = r"(?iU)(?:^|\n|\r|\s{2,})(?:bulgular(?:ımız)?|analiz|inceleme|sonuç|doğrulama|kanıtlar|değerlendirme)\s*:?\s*"
CLAIM_PREFIX = r"(?iU)^(?:iddia|iddia edilen|kontrol edilen iddia|sosyal medyadaki iddia)\s*[:\-–—]\s*"
CLAIM_LABEL = r"(?iU)^\s*İDDİA(?:\s*/\s*[^:]{1,60})?\s*:\s*"
FALSE_LABELS = ("false", "0", "fake", "sahte", "yanlis", "yanlış")
TRUE_TOKENS = ("true", "1", "yes", "evet")
VERDICTS = {"YANLIŞ": "fake", "DOĞRU": "real", "KARMA": "misleading", "BELİRSİZ": "uncertain"}
#: key -> (least characters, least meaningful tokens)
QUALITY_THRESHOLDS = {"article_main": (40, 6), "facturk": (10, 2), "fctr": (15, 2), "mide22": (12, 2), "satiretr": (70, 8)}
GENERIC_PHRASES = (
    "iddia", "iddia edildi", "iddia ediliyor", "iddia edilmiş", "iddia olarak aktarıldı", "iddia olarak aktarılıyor", "iddia olarak aktarılmış",
    "doğru", "yanlış", "gerçek", "yalan", "doğru değil", "yanlış bilgi",
)
REFERENCE_ONLY = (
    r"(?iU)^(?:<USER>\s*)?(?:ilgili|detaylı)?\s*(?:haberimiz|yazımız|açıklama|kaynak|link)\s*:?\s*(?:<URL>)?$",
    r"(?iU)^(?:<USER>\s*)?<URL>$",
)
BOILERPLATE = (r"(?iU)çerez(?:leri)? kabul et", r"(?iU)gizlilik politikası", r"(?iU)üyelik sözleşmesi", r"(?iU)javascript(?:i)? etkinleştirin", r"(?iU)tarayıcınız desteklemiyor")
SOURCE_ALIASES = {
    "aa": "Anadolu Ajansı", "anadolu ajansi": "Anadolu Ajansı", "dha": "DHA", "iha": "İHA", "cihan": "CİHAN", "anka": "ANKA", "posta": "Posta",
    "fanatik": "Fanatik", "ntv": "NTV", "ntv spor": "NTV Spor", "ntvmsnbc": "ntvmsnbc", "reuters": "Reuters", "afp": "AFP", "hurriyet": "Hürriyet",
    "milliyet": "Milliyet", "sabah": "Sabah", "vatan": "Vatan", "star": "Star", "cumhuriyet": "Cumhuriyet", "aksam": "Akşam", "zaman": "Zaman",
    "radikal": "Radikal", "takvim": "Takvim", "cnn turk": "CNN Türk", "trt": "TRT",
}
FINGERPRINTS = {
    "social_media_claim": r"(?iU)\bsosyal medyada\s+(?:paylaşılan|yayılan|yer alan|dolaşıma giren)",
    "claim_according_to": r"(?iU)\biddia(?:ya|sına|sına göre|ya göre)\b",
    "claim_reviewed": r"(?iU)\biddia(?:nın)?\s+incelenmesi\b|\biddia\s+incelendiğinde\b",
    "analysis_heading": r"(?imU)(?:^|\n)\s*analiz\s*:?",
    "findings_heading": r"(?imU)(?:^|\n)\s*bulgular(?:ımız)?\s*:?",
    "verification_result": r"(?iU)\bteyit\s+sonucu\b|\bteyit\s+edildi\b|\bteyit\s+edilemedi\b",
    "teyit_brand": r"(?iU)\bteyit(?:\.org)?\b",
    "dogruluk_payi_brand": r"(?iU)\bdoğruluk\s+payı\b|\bdogrulukpayi\.com\b",
    "dogrula_brand": r"(?iU)\bdoğrula(?:\.org)?\b",
    "malumatfurus_brand": r"(?iU)\bmalumatfuruş\b",
    "trt_haber_brand": r"(?iU)\btrt\s+haber\b",
    "anadolu_ajansi_brand": r"(?iU)\banadolu\s+ajansı\b",
    "agency_city_signature": r"(?iU)\b[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s*\((?:AA|DHA|İHA)\)\s*[-–—:]",
    "aa_news_phrase": r"(?iU)\bAA(?:'nın|’nın|nın)?\s+haberine\s+göre\b",
    "reporter_phrase": r"(?iU)\bmuhabir(?:inin|i|lerince|lerden)?\b",
    "twitter_mention": r"(?iU)(?<!\w)@[A-Za-z0-9_]+",
    "hashtag": r"(?iU)(?<!\w)#[^\s#]+",
    "web_url": r"(?iU)https?://\S+|www\.\S+",
}
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
CITIES = (
    "Adana", "Ankara", "Antalya", "Bursa", "Diyarbakır", "Erzurum", "Eskişehir", "Gaziantep", "Hatay", "İstanbul", "İzmir", "Kayseri", "Kocaeli",
    "Konya", "Malatya", "Mardin", "Mersin", "Samsun", "Şanlıurfa", "Trabzon", "Van",
)
SENSITIVE_TERMS = (
    "seçim", "oy pusulası", "referandum", "cumhurbaşkanlığı seçimi", "deprem", "sel felaketi", "orman yangını", "ölü sayısı", "hayatını kaybetti",
    "yaralı sayısı", "saldırı", "terör", "bomba", "savaş", "intihar", "çocuk istismarı", "aşı", "ilaç tedavisi", "kanser tedavisi",
)
