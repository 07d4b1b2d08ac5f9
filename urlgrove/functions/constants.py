"""Word lists, suffix lists and thresholds that results depend on."""

# Words of credential pages.
LOGIN_KEYWORDS = [
    "login", "signin", "sign-in", "log-in", "logon", "verify", "verification", "validate", "validation", "account", "accounts", "myaccount",
    "secure", "security", "session", "auth", "authenticate", "update", "updated", "confirm", "confirmation", "password", "passwd", "credential",
    "credentials", "wallet", "recover", "recovery", "reset", "unlock", "support", "billing", "invoice", "refund", "webscr", "ebay", "service",
    "client", "customer", "twofactor", "otp", "kyc",
]
# Top-level domains that abuse is common on.
SUSPICIOUS_TLDS = [
    "xyz", "top", "icu", "buzz", "click", "loan", "online", "site", "store", "shop", "vip", "live", "work", "fit", "lol", "rest", "cfd", "sbs",
    "bond", "monster", "cc", "tk", "ml", "ga", "cf", "gq", "club", "support", "win", "biz", "info", "you", "cv", "uno", "country", "stream",
    "review", "party", "racing", "download", "fyi", "page", "host", "space",
]
# Suffixes of several labels, for subdomain counts and effective top-level domains, and the shorter list for registrable domains.
SUFFIXES = ["go.th", "ac.th", "or.th", "co.th", "in.th", "mi.th", "net.th", "com.au", "co.uk", "org.uk", "ac.uk"]
REGISTRABLE_SUFFIXES = ["go.th", "ac.th", "or.th", "co.th", "in.th", "mi.th", "net.th"]
TLD_TYPES = ["go.th", "ac.th", "or.th", "co.th"]
# Registrars and issuers, matched as lower-case substrings.
REGISTRARS = ["thnic", "t.h.nic", "thai network information center", "dotarai", "netway", "z.com", "casbay", "name.com", "godaddy", "cloudflare"]
FREE_ISSUERS = [
    "let's encrypt", "lets encrypt", "zerossl", "google trust services", "gts ca", "buypass go", "actalis free", "ssl.com dv",
    "=r3", "=r10", "=r11", "=r12", "=r13", "=r14", "=e1", "=e5", "=e6", "=e7", "=e8", "=e9",
]
# Hosts of link shorteners.
SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "cutt.ly", "ow.ly", "tiny.cc", "is.gd", "buff.ly", "short.link", "rb.gy", "lnkd.in", "shorturl.at",
    "goo.gl", "t.me", "fb.me", "adf.ly", "v.gd", "trib.al", "s.id", "lin.ee",
]
# Top-level domains that count as cheap in the pattern classes.
CHEAP_TLDS = ["xyz", "top", "cc", "shop", "online", "site", "icu", "click", "vip", "cfd", "bond", "live"]
# Characters that look like another, and that other; full-width letters follow by rule.
CONFUSABLE = "аеорсхуіјһӏԁԛԝѕѡοαρυικνχ๑๐"
LOOKS_LIKE = "aeopcxyijhldqwswoapuikvx10"
FULL_WIDTH = "".join(chr(0xFF41 + k) for k in range(26))
LATIN = "".join(chr(0x61 + k) for k in range(26))
SUSPICIOUS, PHISHING, SAFE_CAP, NO_DISTANCE, TYPO_DISTANCE = 0.3, 0.7, 0.29, 999, 3
LOSS_PER_BLOCK = 7800
# Patterns of a page's title, of a password field, and of official suffixes in a title.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PASSWORD_FIELD = r"(?i)<input[^>]*type=['\"]password['\"]"
OFFICIAL = r"(?i)(?:\.go\.th|\.ac\.th|\.or\.th)"
# The model's features in the order of its vector, and the version of that contract.
CONTRACT_VERSION = "1.5.0"
FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_at", "num_slash", "num_digits", "has_ip", "entropy", "has_https", "num_subdomains", "domain_age_days",
    "is_thai_tld", "tld_type_enc", "is_known_registrar", "min_edit_distance", "is_typosquat", "has_valid_cert", "cert_age_days", "is_self_signed", "whois_ok",
    "tls_ok", "path_depth", "domain_label_max_len", "has_port", "max_digit_run", "has_query_string", "has_punycode", "has_mixed_script", "homoglyph_distance",
    "has_login_keyword", "has_suspicious_tld", "path_brand_hit", "path_length", "num_login_keywords", "query_param_count", "path_entropy", "host_token_count",
    "digit_to_letter_ratio", "cert_is_lets_encrypt", "cert_validity_days", "cert_san_count", "host_has_brand_and_suspicious_tld",
]
# URLs that spoof a brand {b} with its own suffix {c} and a top-level domain {t}, and these domains in turn.
BRAND_PATTERNS = [
    "https://{b}-verify.{t}/login", "https://www.{b}.{c}.{t}/secure-update/auth", "https://login-{b}-2025.{t}/account/confirm", "https://{b}-{t}-secure.cc/verify-account",
    "https://{b}-th-online.{t}/auth/signin", "http://{b}-{t}.top/account/update", "https://{b}.{c}@{t}.com/login", "https://{b}2025.{t}/account/recover",
]
SPOOF_TLDS = ["xyz", "top", "online", "cc", "shop", "site", "icu", "click", "vip", "cfd", "bond", "live"]
