"""Lists, patterns and constants that decide results and must not change."""

# --- fixed values: canonical column order of a lead -------------------------------------------
LEAD_COLUMNS = [
    "company_name", "industry", "category", "website", "email", "phone",
    "whatsapp", "address", "city", "governorate", "country",
    "maps_link", "linkedin_url", "facebook_url", "instagram_url",
    "employees", "description", "contact_person", "source_url",
    "confidence_score", "confidence_tier",
    "dedup_key", "discovered_at", "updated_at", "lead_id",
]

# --- fixed values: e-mail domain and mailbox classes ------------------------------------------
FREEMAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com",
    "icloud.com", "aol.com", "protonmail.com", "mail.com", "zoho.com",
    "msn.com", "yandex.com", "gmx.com",
]
DISPOSABLE_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "10minutemail.com",
    "tempmail.com", "throwawaymail.com", "yopmail.com",
    "getnada.com", "trashmail.com", "sharklasers.com",
]
ROLE_MAILBOXES = [
    "info", "contact", "sales", "support", "admin", "marketing",
    "hello", "office", "inquiries", "enquiries", "booking", "bookings",
    "reservations", "service", "hr", "careers", "jobs", "press",
    "media", "team", "general", "mail", "business", "customer",
    "customerservice",
]

# --- fixed values: hosts ----------------------------------------------------------------------
SOCIAL_HOSTS = {
    "linkedin": ["linkedin.com"],
    "facebook": ["facebook.com", "fb.com", "m.facebook.com"],
    "instagram": ["instagram.com"],
    "twitter": ["twitter.com", "x.com"],
    "youtube": ["youtube.com", "youtu.be"],
    "tiktok": ["tiktok.com"],
}
JUNK_HOST_FRAGMENTS = [
    "youtube.com", "facebook.com", "twitter.com", "x.com", "wikipedia.org",
    "instagram.com", "linkedin.com", "tiktok.com", "pinterest.com",
    "reddit.com", "amazon.", "play.google.com", "apps.apple.com",
    "yelp.com", "tripadvisor.", "duckduckgo.com", "google.com",
    "bing.com", "yahoo.com", "maps.google", "maps.app.goo.gl",
    "pinterest.", "quora.com", "medium.com", "ebay.com", "aliexpress.",
    "wikipedia.", "openstreetmap.org",
]
DIRECTORY_OFFSITE_FRAGMENTS = [
    "facebook.", "twitter.", "instagram.", "linkedin.", "youtube.", "google.",
]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term",
    "utm_content", "fbclid", "gclid", "mc_eid", "_hsenc",
]

# --- fixed values: industry keywords (order breaks ties; "kitchen" counts twice) ---------------
INDUSTRY_KEYWORDS = {
    "Dental & Healthcare": [
        "dental", "dentist", "clinic", "medical", "health", "hospital",
        "dentistry", "orthodont", "doctor", "dermatolog", "pharma", "dental clinic"],
    "Automotive": [
        "car", "auto", "automotive", "dealership", "vehicle", "motors",
        "tire", "tyre", "garage", "rent a car", "car rental"],
    "Software & IT": [
        "software", "it ", "technology", "tech ", "digital", "app development",
        "web development", "saas", "cloud", "cyber", "ai ", "data", "comput"],
    "Construction & Real Estate": [
        "construction", "contractor", "building", "real estate", "property",
        "engineering", "cement", "concrete", "architect"],
    "Logistics & Transport": [
        "logistics", "shipping", "freight", "transport", "courier", "cargo",
        "trucking", "warehouse", "delivery", "supply chain"],
    "Education & Training": [
        "school", "academy", "education", "training", "institute", "university",
        "learning", "course", "center"],
    "Food & Beverage": [
        "restaurant", "cafe", "coffee", "food", "bakery", "catering", "kitchen",
        "fast food", "kitchen"],
    "Retail & E-commerce": [
        "shop", "store", "retail", "mall", "fashion", "market", "ecommerce",
        "e-commerce"],
    "Finance & Banking": [
        "bank", "finance", "financial", "insurance", "investment", "accounting",
        "audit"],
    "Manufacturing": [
        "factory", "manufacturing", "industrial", "production", "plastic",
        "steel", "metal"],
    "Marketing & Media": [
        "marketing", "advertising", "media", "agency", "pr ", "production house"],
    "Beauty & Wellness": [
        "beauty", "spa", "salon", "gym", "fitness", "wellness", "barber"],
    "Legal Services": [
        "law", "lawyer", "legal", "attorney", "advocate"],
}

# --- fixed values: map tags -------------------------------------------------------------------
OSM_VALUE_INDUSTRY = {
    "dentist": "Dental & Healthcare", "doctors": "Dental & Healthcare",
    "clinic": "Dental & Healthcare", "hospital": "Dental & Healthcare",
    "pharmacy": "Dental & Healthcare", "optician": "Dental & Healthcare",
    "car": "Automotive", "car_repair": "Automotive", "car_rental": "Automotive",
    "motorcycle_repair": "Automotive", "tyres": "Automotive",
    "it": "Software & IT", "computer": "Software & IT", "telecommunication": "Software & IT",
    "company": "Construction & Real Estate", "estate_agent": "Construction & Real Estate",
    "architect": "Construction & Real Estate", "engineering": "Construction & Real Estate",
    "lawyer": "Legal Services", "notary": "Legal Services",
    "accountant": "Finance & Banking", "insurance": "Finance & Banking",
    "financial": "Finance & Banking",
    "restaurant": "Food & Beverage", "cafe": "Food & Beverage",
    "fast_food": "Food & Beverage", "bakery": "Food & Beverage", "bar": "Food & Beverage",
    "supermarket": "Retail & E-commerce", "clothes": "Retail & E-commerce",
    "convenience": "Retail & E-commerce", "mall": "Retail & E-commerce",
    "beauty": "Beauty & Wellness", "hairdresser": "Beauty & Wellness",
    "spa": "Beauty & Wellness", "fitness_centre": "Beauty & Wellness",
    "school": "Education & Training", "college": "Education & Training",
    "university": "Education & Training", "training": "Education & Training",
    "kindergarten": "Education & Training",
    "storage": "Logistics & Transport", "courier": "Logistics & Transport",
    "fuel": "Logistics & Transport",
}
OSM_INDUSTRY_TAGS = ["shop", "amenity", "office", "healthcare", "craft"]
OSM_CATEGORY_TAGS = ["shop", "amenity", "office", "healthcare", "craft", "tourism"]
OSM_DESCRIPTION_TAGS = ["shop", "amenity", "office", "healthcare"]
OSM_ADDRESS_TAGS = ["addr:housenumber", "addr:street", "addr:district", "addr:neighbourhood"]
OSM_KEYWORD_TAGS = {
    "dental": ["healthcare", "amenity"],
    "dentist": ["healthcare", "amenity"],
    "clinic": ["amenity"],
    "hospital": ["amenity"],
    "car": ["shop", "amenity"],
    "automotive": ["shop", "amenity"],
    "software": ["office"],
    "it": ["office"],
    "construction": ["office", "craft"],
    "logistics": ["office", "man_made"],
    "restaurant": ["amenity"],
    "lawyer": ["office"],
    "real estate": ["office"],
    "marketing": ["office"],
    "school": ["amenity"],
    "academy": ["amenity"],
    "beauty": ["shop"],
    "salon": ["shop"],
}
OSM_DEFAULT_TAGS = ["shop", "office", "amenity", "healthcare"]
OSM_DEFAULT_RADIUS_M = 8000
OSM_SOURCE_URL = "https://www.openstreetmap.org"
MAPS_LINK_PREFIX = "https://www.google.com/maps/search/?api=1&query="

# --- fixed values: page cues ------------------------------------------------------------------
CONTACT_STEMS = ["contact", "contact-us", "contacts", "about", "about-us",
                 "reach-us", "reach", "get-in-touch", "support"]
ABOUT_STEMS = ["about", "about-us", "company", "who-we-are", "our-story",
               "our-team", "team", "profile"]
NON_PAGE_HREFS = ["#", "mailto:", "tel:", "javascript:"]
TITLE_SEPARATORS = [" | ", " - ", " — ", " :: "]
ADDRESS_WORDS = ["street", "st.", "road", "rd.", "avenue",
                 "district", "building", "floor", "p.o.", "po box"]
PERSON_LABELS = ["Contact Person", "Contact", "Sales Manager",
                 "General Manager", "Owner", "CEO", "Marketing Manager"]
BOILERPLATE_STARTS = ["cookie", "we use", "skip to"]

# --- fixed values: patterns -------------------------------------------------------------------
MAILTO_PATTERN = r"""(?iU)mailto:([^?"'\s>]+)"""
ADDRESS_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
VALID_EMAIL_PATTERN = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}"
    r"[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$")
TEL_PATTERN = r"(?iU)tel:([0-9+().\-\s]+)"
PHONE_PATTERN = r"(?U)\+?\d[\d\-\s().]{7,}\d"
HTTP_LINK_PATTERN = r"(?i)https?://[a-zA-Z0-9_.\-:/?#\[\]@!$&'()*+,;=%~]+"
WHATSAPP_PATTERN = (
    r"(?i)wa\.me/(\d+)|whatsapp\.com/(\d+)|api\.whatsapp\.com.*?phone=(\d+)")
EMPLOYEES_PATTERN = r"(?iU)(\d{1,5})\s*[-+–]?\s*(?:employees|staff|workers|people)"
EMPLOYEES_OVER_PATTERN = (
    r"(?iU)(?:team of|over|more than)\s+(\d{1,5})\s+(?:employees|staff|professionals)")
PERSON_NAME_PATTERN = r"([A-Z][a-zA-Z.'\- ]{3,40})"

# --- fixed values: limits, weights, tiers -----------------------------------------------------
WEIGHTS = {"website": 25, "email": 25, "phone": 20, "social": 15, "description": 15}
PERSON_BONUS = 2
MIN_DESCRIPTION = 40
TIERS = [(80, "A (High)"), (60, "B (Medium)"), (40, "C (Low)")]
LOWEST_TIER = "D (Minimal)"
FACET_SIZE = 25
HISTORY_SIZE = 200
DEFAULT_COUNTRY = "Egypt"
DEFAULT_REGION = "EG"
SOURCES = ["openstreetmap", "search", "directories"]
DEFAULT_SEARCHES = [
    {"query": "Dental Clinics", "city": "Asyut", "country": "Egypt"},
    {"query": "Car Dealerships", "city": "Cairo", "country": "Egypt"},
    {"query": "Software Companies", "city": "Alexandria", "country": "Egypt"},
    {"query": "Construction Companies", "city": "Giza", "country": "Egypt"},
    {"query": "Logistics Companies", "city": "", "country": "Egypt"},
]

# --- fixed values: report labels and headings -------------------------------------------------
TOTALS = {"total": "Total leads in DB        ", "new": "New leads this period    ",
          "updated": "Updated this period      ", "missing_email": "Missing email            ",
          "missing_phone": "Missing phone            ", "missing_contact": "Missing any contact      "}
SECTIONS = ["totals", "top_industries", "top_cities", "sample_new", "sample_missing_contact"]
HEADINGS = ["Totals", "Top Industries (new)", "Top Cities (new)", "Sample New Leads",
            "Sample — Missing Contact Info"]

# --- fixed values: class names of result and listing pages ------------------------------------
CARD_CLASSES = ["result", "search-result", "listing"]
CARD_NAME_CLASSES = ["business-name"]
CARD_SITE_CLASSES = ["track-visit-website", "website", "result-website"]
RESULT_LINK_CLASS = "result__a"
RESULT_BLOCK_CLASS = "b_algo"
