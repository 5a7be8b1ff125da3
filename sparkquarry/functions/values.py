"""Word lists and patterns that decide results, as the rules state them."""

# Keys of names, addresses and domains.
LEGAL = "ltd|limited|inc|incorporated|corp|corporation|co|company|llc|lp|plc"
CENSUS_WORDS = "incorporated|inc|ltd|limited|corp|corporation|company|co|canada|ontario|the|les|aliments|manufacturing|manufacturer|products|product|group"
SEARCH_WORDS = "incorporated|inc|ltd|limited|corp|corporation|company|co|ulc|lp|llc|the"
SUFFIX_WORDS = "inc|incorporated|ltd|limited|corp|corporation|company|co"
NOT_TOKENS = ("and", "the", "inc", "ltd", "limited", "corp", "company", "group", "products", "services", "solutions")
STREET_WORDS = (
    ("road", "rd"), ("street", "st"), ("avenue", "ave"), ("drive", "dr"), ("boulevard", "blvd"),
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
)
POSTAL = r"\b[a-z]\d[a-z][ -]?\d[a-z]\d\b"
NICKNAMES = (("steve", "steven"), ("mike", "michael"), ("joe", "joseph"), ("bob", "robert"), ("rob", "robert"), ("liz", "elizabeth"))
PHONE = r"(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}"
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
SKIP_HOSTS = r"(?:yellowpages|pagesjaunes|canpages|411|google|bing|yahoo|linkedin|facebook|instagram|youtube|indeed|glassdoor|workopolis|jobbank|monster|ziprecruiter|simplyhired|eluta)\."
SKIP_NAMES = r"^(home|about|contact|contacts|locations?|products?|services?|careers?|jobs?|menu|shop|shop online|opening|website|phone number|view map)$"
SKIP_TOKENS = ("canada", "ontario", "limited", "ltd", "inc", "corp", "company", "group", "products", "services")

# The verifier's gates and the strict guard.
_STREETS = "st|street|ave|avenue|rd|road|dr|drive|blvd|boulevard|lane|ln|court|ct|way|pkwy|parkway|circle|cir|highway|hwy|cres|crescent"
PLANT_ADDRESS = r"\b\d{1,6}\s+[A-Za-z0-9.'#&/\- ]+?\b(?:" + _STREETS + r")\b[^.\n]*,\s*[A-Za-z .'-]+,\s*(?:ON|Ontario)"
PAGE_NAME = r"\b(recipe|blog|article|guide|directory|near me|best meat loaf|plastic pollution|getting started showing|home \|)\b"
PAGE_TEXT = r"\b(recipe article|no company name|directory designed to help|find a cafe near me)\b"
VENDOR = r"\b(pest control|extermination|contractor|consulting|software|engineering services|distributor only|wholesale only|retail|cafe|restaurant|bistro|storefront|serving manufacturers|serves .*plants)\b"
OPERATES = r"\b(operates?|manufactures?|produces?|processes?|packages?|facility|plant|production|processing|roastery|brewery|asphalt production|ready[- ]mix|precast|fabrication|molding|extrusion|recycling facility|quarry)\b"
MAKES = r"\b(products?|asphalt|aggregates?|concrete|steel|metal|plastic|composite|fiberglass|food|meat|poultry|beer|cider|coffee|packaging|parts|components)\b"
SCALE = r"\b(plant|facility|production|manufacturing|hot mix|precast|fabrication|molded|industrial|capabilities|products include)\b"
USEFUL_SNIPPET = r"\b(operates?|manufactures?|facility|plant|products include|capabilities)\b"
PLANT_PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
GATE_REASONS = (
    "Not proven to be an actual company.",
    "Not proven to be the operator of a manufacturing or processing plant.",
    "No confirmed facility address in the target area.",
    "Not proven to manufacture or process physical products.",
    "Not proven to be industrial-scale.",
    "Missing minimum proof, confirmed facility, or end product.",
)
END_PRODUCTS = (
    (r"\basphalt\b", "hot mix asphalt"), (r"\baggregate", "aggregates"), (r"\bconcrete\b", "concrete products"),
    (r"\bcomposite|fiberglass", "fiberglass reinforced plastic/composite products"), (r"\bmetal|steel|fabrication", "metal fabricated products"),
)
ANY_PRODUCT = "physical manufactured or processed products"
PLANT_NAMES = (
    (r"\basphalt\b", "hot mix asphalt plant"), (r"\bprecast\b", "precast concrete plant"), (r"\bconcrete\b", "concrete plant"),
    (r"\bfabrication\b", "metal fabrication plant"), (r"\bcomposite|fiberglass", "composites manufacturing facility"), (r"\bmanufactur", "manufacturing facility"),
)
ANY_PLANT = "production facility"
EQUIPMENT = (
    (r"\basphalt\b", ("aggregate conveyors", "dryer drum", "burner", "baghouse", "screens", "loadout silos")),
    (r"\bconcrete|precast\b", ("batch plant", "mixers", "aggregate bins", "conveyors", "silos", "forms")),
    (r"\bmetal|fabrication|steel\b", ("saws", "presses", "welding stations", "cranes", "compressors", "dust collection")),
    (r"\bcomposite|fiberglass\b", ("molds", "mixing equipment", "ovens", "cutting tools", "dust collection", "compressors")),
    ("", ("pumps", "conveyors", "motors", "gearboxes", "compressors")),
)
REJECT_HINTS = (
    "no confirmed southern ontario manufacturing plant found", "no verified southern ontario manufacturing site", "no confirmed manufacturing plant",
    "no confirmed production facility", "not a manufacturer", "not a manufacturing", "service / vendor page", "vendor / integrator", "retail or restaurant",
    "shop bakery specials", "request custom cake quote", "order our most popular custom cake",
)
RANGE_HINTS = ("new jersey", " nj ", " united states", " usa", "massachusetts")
PRODUCT_HINTS = ("not confidently confirmed from public pages yet", "products:missing", "needs products")
STRICT_ADDRESS = r"\b\d{1,6}\s+[A-Za-z0-9.'#&/\- ]+?\b(?:" + _STREETS + r")\b"
STRICT_PHONE = r"(?:\+?1[-.\s]*)?(?:\(?\d{3}\)?[-.\s]*)\d{3}[-.\s]*\d{4}"
STRICT_PLANT = r"\b(manufactur|processing|production|plant|facility|brewery|roastery|asphalt plant|ready[- ]mix|precast|quarry|recycling facility|molding|extrusion|fabricat|machin|packag)\b"
STRICT_NO_PRODUCT = r"\bend products manufactured\*\*\s*(not confidently confirmed|&copy;|copyright|home\b|bakery specials\b|request custom cake quote\b)"
EVIDENCE = r"\b(address|location|facility|plant|manufactur|processing|production|products?|capabilities|asphalt|aggregate|quarry|precast|concrete|brewery|roastery|coffee|bakery|meat|poultry|recycling|molding|extrusion|fabrication|composite|steel|plastic|packaging)\b"

# Industries and census scores.
INDUSTRIES = (
    (r"\bfood|beverage|bakery|sauce|snack|coffee|tea|dairy|meat|brewery|distill|juice|chocolate|confection\b", "Food & Beverage"),
    (r"\bautomotive|component|parts?|metal|steel|aluminum|machin|cnc|stamping|welding|fabricat|equipment|industrial\b", "Industrial / Metal / Components"),
    (r"\bplastic|rubber|mold|mould|extrusion|resin|polymer\b", "Plastics / Rubber"),
    (r"\bpackag|printing|label|paper|corrugat|converting\b", "Packaging / Printing"),
    (r"\bwood|cabinet|millwork|furniture|door|window|flooring|lumber\b", "Wood / Millwork / Furniture"),
    (r"\bconcrete|precast|masonry|stone|brick|building product|construction\b", "Building Products"),
    (r"\bpharma|medical device|health|cosmetic|chemical|cleaner|detergent\b", "Health / Chemical / Cosmetics"),
)
OTHER_INDUSTRY = "Other Manufacturing"
EQUIPMENT_FIT = (
    ("Food", "Likely mixing, batching, conveying, packaging, sanitation, and line maintenance work."),
    ("Industrial|Metal", "Likely fabrication, machining, stamping, assembly, welding, and plant maintenance work."),
    ("Plastics", "Likely molding/extrusion, material handling, conveyors, and maintenance work."),
    ("Packaging", "Likely converting, printing, packaging line, conveyor, and maintenance work."),
    ("Wood", "Likely CNC/cutting, finishing, dust collection, assembly, and maintenance work."),
    ("Building", "Likely batching, cutting, forming, material handling, and maintenance work."),
    ("Health|Chemical", "Likely batching, filling, packaging, sanitation, and maintenance work."),
)
PROCESS_TEXT = r"\bcnc|machining|fabricat|packag|processing|plant|facility|assembly\b"
PROCESS_FIT = "Public page shows process/equipment language; likely fit for maintenance or fabrication support."
NO_FIT = "Manufacturing fit needs a second verification pass."
FOOD_PRODUCTS = (
    ("Meat / protein processing", r"\b(?:meat|poultry|sausage|smokehouse|fish|seafood)\b"),
    ("Bakery / baked goods", r"\b(?:bakery|baker|baking|bread|cake|pastry|cookie)\b"),
    ("Beverages / brewing / coffee", r"\b(?:beverage|brewery|brewing|coffee|roast|juice|tea|kombucha|distill|water)\b"),
    ("Dairy / cheese / creamery", r"\b(?:dairy|cheese|creamery|milk)\b"),
    ("Sauces / spices / dressings", r"\b(?:sauce|spice|seasoning|vinegar|dressing|oil)\b"),
    ("Snacks / confectionery", r"\b(?:snack|chocolate|confection|candy|dessert)\b"),
    ("Grains / flour / milling", r"\b(?:mill|mills|flour|grain|cereal|seed)\b"),
    ("Frozen / prepared foods", r"\b(?:frozen|meal|pasta|noodle|prepared)\b"),
    ("Packaging / co-packing", r"\b(?:packaging|packing|co-pack|copack)\b"),
)
ANY_FOOD = "Food processing / licensed food handling"
MAKER = r"\bmanufacturer|manufacturing|produces?|production|makes?|made in ontario\b"
STRONG_INDUSTRY = r"\b(?:industrial|automotive|component|parts?|equipment|machine|machining|cnc|fabricat|welding|stamping|metal|steel|aluminum|plastic|rubber|packag|printing|converting|food|beverage|bakery|sauce|mix(?:es)?|private label|bulk|processing|bottling|precast|concrete|cabinet|millwork|wood products?|windows?|doors?|pharmaceutical|cosmetic|chemical|medical device|electronics?)\b"
STRONG_CATEGORY = r"\b(?:Industrial|Automotive|Food|Beverage|Home|Construction|Tools|Equipment|Health|Beauty|Components|Building|Packaging|Furniture|Wood|Metal|Plastics?)\b"
COMMERCIAL = r"\b(?:private label|bulk|wholesale|commercial|restaurant chains|retail and foodservice|supply chain|iso|certified)\b"
PROCESS = r"\b(?:cnc|machining|fabricat|stamping|welding|extrusion|molding|moulding|assembly|printing|packaging|processing|bottling|batching|mixing|plant|facility|factory)\b"
ARTISAN = r"\b(?:handmade|hand-crafted|hand crafted|artisan|jewelry|jewellery|crochet|knit|painting|fine art|printable|digital marketing|seo|consulting|photography|wedding|soap|candle|bath bomb|apothecary|tarot|crystal|boutique|fashion|apparel|t-shirt|t shirt|skincare only|skin care only|one woman|home-based|home based|small batch candles|hand poured)\b"
STREET_ADDRESS = r"\b(?:unit|suite|#|\d{1,5}\s+[A-Za-z].*\b(?:road|rd|drive|dr|court|crt|boulevard|blvd|avenue|ave|street|st|lane|crescent|cres)\b)"
REGISTRY_PROCESS = r"\b(?:processing|processor|manufactur|plant|packag|co-?pack)\b"
REGISTRY_PRODUCT = r"\b(?:bakery|baker|baking|brewery|brewing|distill|roast|roaster|meat pack|poultry|sausage|smokehouse|dairy|cheese|creamery|confection|chocolate|candy|sauce|spice|seasoning|beverage|mill|mills|flour|frozen|prepared food|nutrition)\b"
REGISTRY_LEGAL = r"\b(?:inc|ltd|limited|corp|corporation|ulc|lp)\b"

# Persons, titles and roles.
PERSON_SHAPE = r"^[A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,4}$"
NOT_PERSON = r"\b(facility|facilities|plant|products?|services?|operations|manufacturing|company|team|careers?|contact|locations?|site|shop|home|office|virtual|tour|website|auto parts|food|water|healthcare|technology|aggregates?|construction|solutions|equipment|family)\b"
NOT_PERSON_START = r"^(?:the|what|recently|entrepreneurial|canadian|american|ontario|new|old)\b"
TITLE_TERMS = (
    "site director of manufacturing", "director of manufacturing", "manufacturing manager", "manufacturing supervisor", "manufacturing leader",
    "production and manufacturing leader", "manufacturing and operations leader", "chief operating officer", "chief operations officer", "coo",
    "director of operations", "operations director", "plant manager", "plant supervisor", "plant superintendent", "operations manager",
    "operations supervisor", "operations leader", "operations", "operator", "acquirer", "owner", "founder", "president", "vice president", "vp",
    "partner", "board member", "production manager", "production supervisor", "production lead", "team lead", "lead hand", "maintenance manager",
    "maintenance supervisor", "maintenance mechanic", "millwright", "maintenance technician", "industrial mechanic", "engineering manager",
    "quality manager", "quality assurance", "quality control", "qa manager", "qa supervisor", "qa specialist", "qa technician",
    "quality assurance specialist", "haccp coordinator", "food safety", "technical services", "materials and processing supervisor", "head brewer",
    "lead brewer", "brewer", "brewing assistant", "brewery manager", "cellar(?:man|person)", "roast master", "head roaster", "roaster",
    "site supervisor", "warehouse manager", "warehouse supervisor", "logistics supervisor", "logistics manager", "shipping manager",
    "receiving manager", "inventory manager", "dispatch manager", r"dispatch\s*&\s*logistics manager", "purchas(?:er|ing)", "purchasing manager",
    "buyer", "procurement", "procurement manager", "supply chain", "supply chain manager", "supply chain director", "facilities manager",
    "facility manager", "supervisor", "sanitation worker", "machine operator", "general manager",
)
WEAK_TITLE = r"\b(?:operations?\s*/\s*(?:manufacturing|maintenance|plant)?\s*staff|staff|employee|owner-adjacent|operations-related role|plant floor|title not public|title not disclosed|exact role|exact title|not stated|not disclosed)\b"
EXCLUDED_TITLE = r"\b(?:chief financial officer|cfo\b|finance|accounting|controller|sales|marketing|human resources|hr\b|front of house|software developer|it support|information technology|consultant|customer service|intake executive)\b"
EXCLUDED_BUT = r"\b(?:operations|production|plant|maintenance|manufacturing|facility|quality|qa\b|technical services|engineering|warehouse|logistics|supply chain|procurement|purchasing|buyer|owner|founder)\b"
STALE_CONTACT = r"\b(historical|alleged|outdated|not verified|may be outdated|not verified as current)\b"
STRONG_ROLE = r"\b(?:plant manager|plant supervisor|maintenance manager|maintenance supervisor|production manager|production supervisor|operations manager|operations supervisor|quality assurance manager|qa manager|quality manager|procurement manager|purchasing manager|warehouse manager|logistics manager|head brewer|lead brewer|brewery manager|head roaster|owner|founder|president|vice president|vp)\b"
SCORED_ROLE = r"\b(?:plant|maintenance|production|operations|quality|qa|head brewer|brewer|roaster|owner|founder|president|vice president|vp|general manager)\b"
DIRECTORY_TITLE = r"phone number|zoominfo|rocketreach|about\s+"
CRM_BLOCK = r"\b(?:team|department|office|staff|contact|info|sales|support|company|inc|ltd|limited|corp|corporation|operations|plant|facility|personnel|public|provided|granite|metal|recycling|concrete|products?|services?)\b"
CRM_WEAK = r"\b(?:general contact|general inquiries?|not provided|information only|profile owner|team|personnel|facility-level contact|operations contact|contact\s*/\s*operations|not confirmed|potential|staff|front office|main office|sales|office manager|customer service)\b"
CRM_TARGET = r"\b(?:plant|production|operations?|maintenance|manufacturing|facility|quality|qa\b|food safety|technical services|engineering|warehouse|logistics|supply chain|procurement|purchasing|buyer|head brewer|lead brewer|brewer|brewery manager|head roaster|roaster|general manager|owner|founder|president|vice president|vp|coo|operator|supervisor|manager|millwright|mechanic)\b"
CRM_EXCLUDE = r"\b(?:sales|marketing|human resources|hr\b|finance|accounting|customer service|office manager|front office|general inquiries?)\b"
CRM_EXCLUDE_BUT = r"\b(?:owner|founder|president|operations?|production|plant|maintenance|manufacturing|facility|quality|qa\b|technical services|engineering|warehouse|logistics|procurement|purchasing|buyer|operator|supervisor|millwright|mechanic)\b"
OUTREACH_BLOCK = r"\b(?:team|department|office|staff|contact|info|sales|support|company|inc|ltd|limited|corp|corporation|operations|plant|facility|personnel|public|provided|products?|services?)\b"
OUTREACH_BAD = r"\b(?:former|retired|deceased|left|past role|not current|not verified|unverified|unknown|title not public|sales|marketing|human resources|hr\b|finance|accounting|customer service|front office|general inquiries?)\b"
OUTREACH_RANK = r"\b(?:manager|supervisor|director|lead|chief|head)\b"
REPLACED_TITLE = r"\b(?:title not public|title not available|title not found|operations contact|operations tied contact|unknown)\b"
PAST_ROLE = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+20\d{2}\s*[-–]\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+20\d{2}\b"
ROLE_HINTS = (
    (r"\bchief operating officer\b|\bchief operations officer\b|\bcoo\b", "Chief Operating Officer"), (r"\bdirector of operations\b|\boperations director\b", "Director of Operations"),
    (r"\bproduction and manufacturing leader\b", "Production and Manufacturing Leader"), (r"\bmanufacturing leader\b", "Manufacturing Leader"),
    (r"\bhead brewer\b", "Head Brewer"), (r"\blead brewer\b", "Lead Brewer"), (r"\bbrewing assist(?:ant|\.)?\b", "Brewing Assistant"),
    (r"\bbrewery manager\b", "Brewery Manager"), (r"\bbrewer\b", "Brewer"), (r"\bhead roaster\b", "Head Roaster"), (r"\broast master\b", "Roast Master"),
    (r"\broaster\b", "Roaster"), (r"\bmachine operator\b", "Machine Operator"), (r"\bsanitation worker\b", "Sanitation Worker"),
    (r"\bquality assurance specialist\b", "Quality Assurance Specialist"), (r"\bqa specialist\b", "QA Specialist"),
    (r"\bquality assurance manager\b", "Quality Assurance Manager"), (r"\bqa manager\b", "QA Manager"), (r"\bmaintenance supervisor\b", "Maintenance Supervisor"),
    (r"\bproduction manager\b", "Production Manager"), (r"\boperations manager\b", "Operations Manager"), (r"\bfacilit(?:y|ies) manager\b", "Facility Manager"),
    (r"\bplant manager\b", "Plant Manager"), (r"\bsupervisor\b", "Supervisor"), (r"\bboard member\b", "Board Member"), (r"\bpartner\b", "Partner / operator"),
    (r"\bowner\b", "Owner / operator"), (r"\bfounder\b", "Founder / operator"), (r"\bvice president\b|\bvp\b", "Vice President"),
    (r"\bpresident\b", "President"), (r"\boperator\b", "Operator"),
)

# Recent signals.
SIGNAL_INCLUDE = r"\b(hiring|hire|job opening|job posting|careers?|recruiting|recruitment|seeking|millwright|maintenance mechanic|maintenance technician|production operator|production supervisor|plant manager|operations manager|head brewer|brewer|brewing assistant|roaster|head roaster|expansion|expand|expanding|expanded|new facility|new plant|new site|new production line|production line|capacity|permit|approval|environmental compliance approval|eca|construction|investment|investing|planned expansion)\b"
SIGNAL_HIRING = r"\b(hiring|hire|job opening|job posting|job ad|jobs?|careers?|employment|recruiting|recruitment|seeking|apply|now hiring)\b"
SIGNAL_ROLE = r"\b(millwright|maintenance mechanic|maintenance technician|industrial mechanic|production operator|production worker|production associate|production supervisor|production manager|plant manager|plant supervisor|operations manager|operations supervisor|warehouse|logistics|quality assurance|quality control|qa\b|food safety|sanitation|packaging|machine operator|head brewer|brewer|brewing assistant|roaster|head roaster)\b"
SIGNAL_GROWTH = r"\b(expansion|expand|expanding|expanded|planned expansion|new facility|new plant|new site|new location|opening|opened|relocat(?:e|ing|ed)|larger facility|production line|capacity|capacity increase|permit|approval|environmental compliance approval|eca|construction|building permit|investment|investing|invested|capital project|equipment upgrade|plant upgrade)\b"
SIGNAL_JOB_BOARD = r"(?:indeed|glassdoor|workopolis|jobbank|monster|ziprecruiter|simplyhired|eluta)\."
SIGNAL_OTHER_ROLE = r"\b(barista|server|cashier|retail associate|sales associate|store associate|customer service|front of house|restaurant|cook|brand ambassador)\b"
SIGNAL_NEGATIVE = r"\b(permanently clos(?:e|es|ed|ing)|plant closure|closed plants?|shut(?:ter| down)|recall|outbreak|listeria|bankrupt|layoff|lawsuit|for sale|sell(?:ing)? (?:two )?plants?)\b"
SIGNAL_ROLES = (
    ("Head Brewer", r"\bhead brewer\b"), ("Brewer", r"\b(?:lead brewer|brewer|brewing assistant)\b"), ("Head Roaster", r"\bhead roaster\b"), ("Roaster", r"\broaster\b"),
    ("Maintenance Mechanic", r"\bmaintenance mechanic\b"), ("Maintenance Technician", r"\bmaintenance technician\b"), ("Millwright", r"\bmillwright\b"),
    ("Industrial Mechanic", r"\bindustrial mechanic\b"), ("Production Supervisor", r"\bproduction supervisor\b"), ("Production Manager", r"\bproduction manager\b"),
    ("Production Operator", r"\bproduction operator\b"), ("Production Worker", r"\bproduction worker\b"), ("Plant Manager", r"\bplant manager\b"),
    ("Plant Supervisor", r"\bplant supervisor\b"), ("Operations Manager", r"\boperations manager\b"), ("Operations Supervisor", r"\boperations supervisor\b"),
    ("Warehouse/Logistics", r"\b(?:warehouse|logistics)\b"), ("Quality/QA", r"\b(?:quality assurance|quality control|qa\b|food safety)\b"),
    ("Sanitation", r"\bsanitation\b"), ("Machine Operator", r"\bmachine operator\b"),
)
SIGNAL_PERMIT = r"\b(permit|approval|environmental compliance approval|eca|building permit)\b"
SIGNAL_CAPACITY = r"\b(capacity|production line|equipment upgrade|plant upgrade)\b"
SIGNAL_PLANNED = r"\b(planned expansion|planning to expand|proposed expansion)\b"
SIGNAL_OLD_YEAR, SIGNAL_NEW_YEAR = r"\b20(?:0\d|1\d|20|21|22|23)\b", r"\b20(?:24|25|26)\b"
SIGNAL_CURRENT = r"\b(?:current|now hiring|actively hiring|planned|proposed|upcoming)\b"
DATE_HINT = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+20\d{2}\b"

# Companies that outreach may write to.
CLOSED_STAGE = r"\b(?:closed|lost|unqualified|do not|duplicate|needs products)\b"
GATE_PAGE_NAME = r"^(?:about|home|homepage|contact|contact us|products?|services?|locations?|careers?|shop|store)\b"
GATE_HEAVY = r"\b(?:concrete|sawing|drilling|asphalt|aggregate|metal|steel|plastics?|packaging)\b"
GATE_EATING, GATE_BREWING = r"\b(?:restaurant|bistro|cafe|pub|grill|bar)\b", r"\b(?:brewery|brewing|roaster|bakery|foods?|beverage)\b"
GATE_FOOD = r"\b(?:food|beverage|brewery|brewing|brewer|cider|distill|bakery|bakeries|baked|meat|poultry|dairy|cheese|coffee|roast|chocolate|candy|snack|sauce|soup|frozen|ingredient|co-?pack|bottl|cann|packag|process|production|manufactur|plant|facility)\b"
GATE_RETAIL = r"\b(?:restaurant|bistro|cafe|pub|market|grocery|retail|storefront|caterer|catering)\b"
GATE_INDUSTRIAL = r"\b(?:plant|facility|production|processing|manufactur|brewery|brewing|bottl|cann|co-?pack|industrial|commercial bakery|roaster|packag)\b"

# Saved leads.
READY = "Ready for Outreach"
STAGES = (READY, "Plant Verified - Needs Products", "Plant Verified - Needs Contact", "Plant Verified - Needs Contact + Products")
NO_CONTACT = r"no named maintenance / operations / plant contact found yet|no named individual maintenance / operations linkedin contact"
NO_PRODUCTS = r"not confidently confirmed from public pages yet|no confirmed end products"
NO_PLANT = r"no confirmed southern ontario manufacturing plant found|no verified southern ontario manufacturing site"

# Pages.
CITIES = r"\b(Toronto|Mississauga|Brampton|Vaughan|Markham|Pickering|Oshawa|Cambridge|Guelph|Hamilton|Kitchener|Waterloo|Burlington|Oakville|Whitby|Ajax|Aurora|Bradford|Milton|Welland|St\.?\s*Catharines|Thorold|Niagara Falls|Richmond Hill|Scarborough|North York|Etobicoke|Concord|Woodbridge|Gormley)\b"
ADDRESS_CITY = r"\b(toronto|milton|burlington|oakville|mississauga|brampton|ancaster|hamilton|markham|guelph|kitchener|cambridge|waterloo|vaughan|north york|etobicoke|scarborough|stouffville|richmond hill|woodbridge|brantford)\b"
ADDRESS_OFFICE = r"\b(head office|corporate office|media enquiries)\b"
ADDRESS_STREET = r"\b\d{1,6}\s+[A-Za-z0-9.'#&,\-/ ]{4,160}\b"
ADDRESS_TYPE = r"\b(st|street|ave|avenue|rd|road|dr|drive|blvd|boulevard|lane|ln|court|ct|way|pkwy|parkway|circle|cir|cres|crescent|trail|trl|suite|unit)\b"
ADDRESS_START = (r"^(pickup available, usually ready in \d+ hours,\s*)", r"^(view project,\s*)", r"^(head office,\s*)")
PAGE_LABELS = ("team", "our team", "leadership", "our leadership team", "products", "our products", "our beers", "our brewery", "about", "about us", "home", "contact", "contact us")
LINK_HINTS = (
    "/our-brewery", "/our-team", "/people", "/leadership", "/team", "/management", "/operations", "/products", "/product", "/beers", "/beer", "/coffee",
    "/roastery", "/shop", "/locations", "/location", "/facilities", "/facility", "/plant", "/plants", "/manufacturing", "/capabilities", "/contact",
    "/contact-us", "/about", "/about-us", "/our-story", "/who-we-are", "/news", "/newsroom", "/careers", "/jobs",
)
ENTITIES = (  # of the page reader, in its order
    (r"&#8211;|&#x2013;|&ndash;", "-"), (r"&#8212;|&#x2014;|&mdash;", "-"), (r"&#8216;|&#8217;|&rsquo;|&lsquo;", "'"), (r"&#8220;|&#8221;|&ldquo;|&rdquo;", '"'),
    (r"&#38;|&amp;", "&"), (r"&#39;|&apos;", "'"), (r"&nbsp;", " "),
)
ENTITIES_RESEARCH = (("&amp;", "&"), ("&#038;", "&"), ("&#039;", "'"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
ENTITIES_SEARCH = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
ORGANISATION = r"\b(Organization|Corporation|LocalBusiness|FoodEstablishment)\b"

# Search results and mail domains.
TRUSTED_HOSTS = (
    "linkedin.com", "wiza.co", "signalhire.com", "clodura.ai", "adapt.io", "contactout.com", "rocketreach.co", "zoominfo.com", "apollo.io", "lusha.com",
    "theorg.com", "glassdoor.com", "glassdoor.ca", "greatplacetowork.ca", "greatplacetowork.com",
)
BLOCKED_HOSTS = (  # with all below them
    "duckduckgo.com", "bing.com", "bbb.org", "datagemba.com", "aeroleads.com", "allpages.com", "cylex-canada.ca", "canadapages.com", "canadaubm.com",
    "canpages.ca", "ctidirectory.com", "concrete.org", "edir24.com", "clutch.co", "firmania.ca", "workopolis.com", "indeed.com", "linkedin.com",
    "investburlington.ca", "miltonchamber.ca", "indianbusinesscanada.com", "ontariobusinessdir.com", "ontario.ca", "processing.org",
    "supportontariomade.ca", "scottsdirectories.com", "canada.ca", "gc.ca", "akama.ca", "usnews.com", "facebook.com", "instagram.com", "x.com",
    "twitter.com", "yellowpages.ca", "canada411.ca", "companylisting.ca", "canada-listing.com", "yelp.ca", "yelp.com", "mapquest.com", "dnb.com",
    "zoominfo.com", "opencorporates.com", "glassdoor.ca", "exploretock.com", "opentable.com", "eater.com", "apple.com", "baidu.com", "zhihu.com",
    "weforum.org", "wikipedia.org", "sciencedirect.com", "wordreference.com", "reddit.com", "redflagdeals.com", "environment.ec.europa.eu",
    "environment.nsw.gov.au", "4pda.to",
)
SKIP_RESULT = (
    ".pdf", "/pdf/", " filetype:pdf", "search?q=", "manufacturing-companies", "major-employers", "business directory", "local directory",
    "company directory", "manufacturer directory", "category/", "categories/", "near ", " near ", "nearby", "review", "reviews", "residential",
    "driveway", "landscape", "landscaping", "sealing", "paving", "contractor", "contractors", "repair", "installation", "services", "restaurant",
    "restaurants", "menu", "reservation", "reservations", "book a table", "dining", "brunch", "lunch", "dinner", "cafe", "company in", "companies in",
    "manufacturers near", "manufacturers in", "top companies", "top industrial companies", "best companies", "list of", "opening hours",
    "get direction", "photos", "forum", "question", "answer", "topicdetail", "documentation", "resources", "factory outlet", "shoe outlet",
)
SKIP_JOBS = ("/jobs/", "jobs in", "job opening")
FOOD_PLANT = r"\b(roast|roastery|brewery|manufactur|plant|facility|production|processing)\b"
PLANT_RESULT = r"\b(manufactur|plant|facility|factory|production|processing|fabricat|recycling|concrete|asphalt|aggregate|food|beverage|bakery|metal|steel)\b"
NOT_OFFICIAL = (  # of which part of a result, and what else must hold of the part
    ("url", r"/(category|categories|directory|search|topic|question|answers?|forums?)\b"),
    ("title", r"\b(bbb|directory|directories|near|review|reviews|forum|wiki|question|answer)\b"),
    ("title", r"\b(residential|driveway|landscape|landscaping|sealing|paving|repair|installation|service)\b"),
)
COMPARING = (r"\b(find|compare|browse)\b", r"\b(companies|businesses|manufacturers)\b")
EATING_TITLE = r"\b(beer store|bottle shop|convenience store|butcher shop|market|restaurant|restaurants|menu|reservation|dining|brunch|lunch|dinner|cafe|pub|brewpub|brewhouse)\b"
EATING = r"\b(restaurant|restaurants|menu|reservation|dining|brunch|lunch|dinner|cafe)\b"
SOCIAL_HOST = r"(facebook|instagram|twitter|x\.com|linkedin|youtube|youtu\.be|tiktok|pinterest|reddit|wikipedia|crunchbase|bloomberg|yelp|indeed|glassdoor|maps\.google|goo\.gl|bit\.ly|google\.com|duckduckgo\.com|bing\.com)"
MAIL_URL = r"""(https?://[^\s<>"'`)]+|\bwww\.[^\s<>"'`)]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\.(?:com|ca|net|org|co|us|io)\b)"""
DIRECTORY_HOST = r"\b(?:news|magazine|directory|association|linkedin|facebook|instagram|indeed|glassdoor|zoominfo|rocketreach|signalhire|wiza|apollo|contactout|foodengineeringmag|jobbank|workopolis|yellowpages|canpages)\b"
JUNK_ALIAS = r"\b(?:verified|manufacturing|facilities|southern|ontario|contact|products?|homepage|home)\b"

# The context of search results.
SEARCH_TALK = (
    "recent", "hiring", "expansion", "signal", "signals", "relevant", "targeted", "search", "verified", "plant", "lead", "manufacturing", "facilities", "southern", "ontario", "products",
    "capabilities", "official", "source", "evidence", "matters",
)
LOCAL_TERMS = "Canada|Canadian|Ontario|ON|Greater Toronto|GTA|Toronto|Vaughan|Woodbridge"

# Searches for people, by phase.
WIDE_SEARCHES = (
    '"{alias}" LinkedIn', '"{alias}" employees', '"{alias}" employee directory', '"{alias}" management team', 'site:linkedin.com/in "{alias}"', 'site:ca.linkedin.com/in "{alias}"',
    'site:wiza.co "{alias}"', 'site:rocketreach.co "{alias}"', 'site:zoominfo.com "{alias}"', 'site:signalhire.com "{alias}"', 'site:apollo.io "{alias}"', 'site:theorg.com "{alias}"',
)
PRIORITY_SEARCHES = (
    '"{alias}" "acquired"', '"{alias}" "operator"', '"{alias}" "owner"', 'site:linkedin.com/in "{alias}" "acquired"', 'site:ca.linkedin.com/in "{alias}" "acquired"',
    'site:linkedin.com/in "{alias}" "operator"', 'site:ca.linkedin.com/in "{alias}" "operator"', 'site:linkedin.com/in "{alias}"', 'site:ca.linkedin.com/in "{alias}"',
    'site:rocketreach.co "{alias}"', 'site:zoominfo.com "{alias}"', 'site:signalhire.com "{alias}" employees', 'site:allbiz.ca "{alias}"', 'site:wiza.co "{alias}"',
    '"{alias}" "Operations Manager" "Bakers Journal"', '"{alias}" "Quality Assurance Manager" "Bakers Journal"',
)
PRIORITY_TITLES = (
    "head brewer", "brewing assistant", "brewer", "head roaster", "roaster", "plant manager", "operations manager", "production manager", "maintenance supervisor", "maintenance manager",
    "quality assurance manager", "quality assurance specialist", "qa manager", "qa specialist", "supervisor", "machine operator", "sanitation worker", "operator", "owner", "president",
    "vice president", "vp", "founder", "partner", "board member", "acquired",
)
PRIORITY_TITLE_SEARCHES = (
    '"{alias}" "{title}"', 'site:linkedin.com/in "{alias}" "{title}"', 'site:ca.linkedin.com/in "{alias}" "{title}"', 'site:signalhire.com "{alias}" "{title}"', 'site:allbiz.ca "{alias}" "{title}"',
)
NARROW_TITLES = (
    "maintenance manager", "maintenance supervisor", "maintenance technician", "millwright", "plant manager", "facility manager", "production manager", "production supervisor",
    "operations manager", "director of operations", "chief operating officer", "quality assurance manager", "quality manager", "technical services manager", "engineering manager",
    "warehouse manager", "logistics manager", "supply chain manager", "procurement manager", "purchasing manager", "head brewer", "brewing assistant", "brewer", "head roaster", "roaster",
    "owner", "president",
)
NARROW_SEARCHES = (
    '"{alias}" "{title}"', 'site:linkedin.com/in "{alias}" "{title}"', 'site:ca.linkedin.com/in "{alias}" "{title}"', 'site:wiza.co "{alias}" "{title}"',
    'site:rocketreach.co "{alias}" "{title}"', 'site:zoominfo.com "{alias}" "{title}"',
)
REPAIR_TITLES = (
    "plant manager", "maintenance manager", "production manager", "operations manager", "quality manager", "quality assurance", "technical services", "facility manager", "warehouse manager",
    "procurement", "purchasing", "owner", "president", "vice president", "general manager",
)
REPAIR_SEARCHES = (
    '"{name}" "{alias}" LinkedIn', 'site:linkedin.com/in "{name}" "{alias}"', 'site:ca.linkedin.com/in "{name}" "{alias}"', 'site:rocketreach.co "{name}" "{alias}"',
    'site:zoominfo.com "{name}" "{alias}"', 'site:wiza.co "{name}" "{alias}"',
)
REPAIR_TITLE_SEARCHES = ('"{name}" "{alias}" "{title}"', 'site:linkedin.com/in "{name}" "{alias}" "{title}"', 'site:ca.linkedin.com/in "{name}" "{alias}" "{title}"')
