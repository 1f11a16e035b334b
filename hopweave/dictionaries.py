"""Word lists and patterns.

Fixed values: results depend on each entry, so they are stated as plain text.
"""

TITLES = "mr mrs ms miss dr prof professor sir dame lord lady rev reverend hon capt captain gen col lt sgt sen senator rep judge justice".split()
SUFFIXES = "jr sr ii iii iv v phd md dds esq mba ma ba".split()
PARTICLES = "de del della di da van von der den ter la le bin ibn al st mac mc o".split()

#: formal: short forms
NICKNAMES = dict(
    line.split(": ")
    for line in """robert: bob rob bobby robbie
william: will bill billy willie
richard: rick dick richie rich
james: jim jimmy jamie
john: jack johnny jon
michael: mike mick micky
christopher: chris topher
katherine: kate katie kathy kat catherine
elizabeth: liz beth betsy eliza lizzie libby
margaret: maggie meg peggy greta
patricia: pat patty trish
jennifer: jen jenny
thomas: tom tommy
anthony: tony
daniel: dan danny
matthew: matt
nicholas: nick nico
andrew: andy drew
joseph: joe joey
edward: ed eddie ted teddy ned
charles: charlie chuck chas
stephen: steve steven
alexander: alex sasha xander
benjamin: ben benji
samuel: sam sammy
susan: sue susie suzy
deborah: deb debbie
rebecca: becca becky
victoria: vicky tori
priyanka: priya
abhishek: abhi
abhimanyu: abhi
lawrence: larry laurie lars
laurence: larry laurie
theodore: ted teddy theo
ronald: ron ronnie
donald: don donnie
kenneth: ken kenny
gerald: gerry jerry
jeffrey: jeff
gregory: greg
timothy: tim timmy
peter: pete
philip: phil
phillip: phil
frederick: fred freddie
albert: al bert
alfred: al fred
arthur: art artie
eugene: gene
francis: frank fran
harold: harry hal
henry: hank harry
howard: howie
leonard: len lenny
martin: marty
raymond: ray
russell: russ
vincent: vince
walter: walt
zachary: zach zack
jonathan: jon johnny jonny
joshua: josh
nathaniel: nate nathan
gabriel: gabe
barbara: barb babs
cynthia: cindy
dorothy: dot dottie
kimberly: kim
pamela: pam
sandra: sandy
stephanie: steph steffi
virginia: ginny
charlotte: lottie
alexandra: alex sasha lexi
veronica: ronnie
theresa: terry tess
teresa: terry tess""".splitlines()
)

ORG_MARKERS = """inc llc ltd corp corporation company university institute college school foundation hospital center centre
group partners capital ventures labs laboratory association society council committee department ministry agency bank trust press journal
times post news street avenue road monday tuesday wednesday thursday friday saturday sunday january february march april may june july
august september october november december the this that these those his her their""".split()
ORG_NAME_MARKERS = """biosciences bioscience biosystems therapeutics pharmaceuticals pharma biopharma biotech diagnostics genomics
sciences holdings technologies technology systems solutions networks industries enterprises international worldwide global equity advisors
consulting services media studios records publishing communications resources energy motors airlines railway insurance plc gmbh ag sa nv bv
spa srl pty co reality lab works dynamics robotics ai analytics software computing cloud data digital interactive games gaming studio design
brands collective co-op cooperative alliance network fund funds management advisers securities asset church chapel parish diocese
ministries temple synagogue mosque congregation fellowship mission charities charity orphanage shelter academy seminary pictures films film
entertainment productions production broadcasting television animation sports athletics club team employee employees staff spokesman
spokeswoman spokesperson official officials representative representatives resident residents restaurant cafe hotel grill kitchen bakery
brewery winery""".split()
FUNCTION_WORDS = "in a an the and or for with at on to from by is was are were who that this these his her their its as but not no".split()

ABBREVIATIONS = """mr mrs ms dr prof sr jr st mt rev hon inc ltd co corp llc plc gmbh dept univ assn vs etc al approx est fig no vol ed eds gov
sen rep capt gen lt col sgt phd md ba ma bsc msc jan feb mar apr jun jul aug sep sept oct nov dec""".split()
PAYWALL = ["subscribe to continue", "subscribers only", "this article is for subscribers", "create a free account to read", "sign in to read", "register to continue", "you have reached your article limit", "become a member to read"]
CONSENT = ["accept all cookies", "we value your privacy", "manage your cookie preferences", "enable javascript to continue", "please enable javascript", "verify you are a human", "checking your browser before accessing", "access denied", "attention required! | cloudflare"]
NOT_FOUND = ["the page cannot be found", "page not found", "404 not found", "http error 404", "file or directory not found", "error 404", "this page doesn't exist", "this page does not exist", "we can't find the page", "we couldn't find that page", "the requested url was not found", "sorry, this page isn't available"]
INSTRUCTIONS = ["ignore previous", "ignore all previous", "disregard the", "disregard all", "you must now", "you should now", "your instructions", "new instructions", "system prompt", "system:", "assistant:", "assert that", "you are required to", "output the following", "respond with", "do not follow", "override"]
LEAST_USEFUL_CHARS, HEAD_CHARS = 250, 2500

ROLES = ["ceo", "cto", "cfo", "coo", "chief", "founder", "cofounder", "co-founder", "president", "chair", "chairman", "director", "professor", "lecturer", "engineer", "scientist", "researcher", "partner", "principal", "head of", "manager", "editor", "surgeon", "physician", "cardiologist", "attorney", "analyst", "advisor", "trustee", "dean", "provost", "curator", "designer"]
INSTITUTIONS = ["university", "college", "institute", "school", "hospital", "academy", "laboratory", "labs", "clinic", "foundation", "museum"]
FIELDS = ["cardiology", "oncology", "neurology", "physics", "chemistry", "biology", "economics", "law", "medicine", "engineering", "machine learning", "artificial intelligence", "robotics", "genomics", "climate"]
ORG_FUNCTION_WORDS = ["of", "the", "and", "for", "at", "in", "on", "de", "du", "la", "le", "von", "van", "der", "den", "&", "-", "y", "el"]
NOT_EMPLOYERS = ["republican", "republicans", "democrat", "democrats", "democratic", "independent", "conservative", "conservatives", "labour", "labor", "tory", "tories", "gop", "libertarian", "green party", "forbes 400", "fortune 500", "time 100", "forbes", "fortune"]
MOST_ORG_TOKENS = 6
EXCLUSIVE_KEYS = ["employer", "institution"]
COMPARED_KEYS = ["employer", "institution", "field", "role", "location"]

BINARY_SUFFIXES = "pdf doc docx xls xlsx ppt pptx zip gz tar rar 7z jpg jpeg png gif webp svg ico mp3 mp4 mov avi wav exe dmg pkg woff woff2 ttf css js json xml rss".split()
BLOCKED_DOMAINS = """linkedin.com facebook.com instagram.com threads.net x.com twitter.com tiktok.com pinterest.com reddit.com quora.com
youtube.com rocketreach.co zoominfo.com signalhire.com lusha.com apollo.io contactout.com leadiq.com hunter.io crunchbase.com tracxn.com
glassdoor.com indeed.com academia.edu researchgate.net scribd.com podcasters.spotify.com redcircle.com anchor.fm""".split()
RETRY_STATUS = [408, 425, 429, 500, 502, 503, 504]

HEADERS = {
    "first": ["first name", "firstname", "given name", "vorname", "prénom", "prenom", "nome"],
    "last": ["last name", "lastname", "surname", "family name", "nachname", "nom", "cognome"],
    "full": ["full name", "name", "contact name", "display name"],
    "role": ["position", "title", "job title", "headline", "role"],
    "company": ["company", "organization", "organisation", "current company", "employer"],
    "url": ["url", "profile url", "public profile url", "linkedin url", "profile link"],
    "connected": ["connected on", "connected_on", "date connected", "connection date"],
}

#: Query templates: text with places, required places.
TEMPLATES = {
    "context": ('"{name}" "{context}"', ["context"]),
    "colleagues": ('"{name}" cofounder OR colleague OR "worked with"', []),
    "governance": ('"{name}" board OR advisor OR trustee', []),
    "employer_team": ('"{name}" "{employer}" team OR staff OR leadership', ["employer"]),
    "profile": ('"{name}" interview OR profile OR bio', []),
    "direct_bridge": ('"{name}" "{other}"', ["other"]),
    "past_employers": ('"{name}" "previously at" OR "formerly at" OR "before joining"', []),
    "org_roster": ('"{employer}" "our team" OR partners OR people OR leadership', ["employer"]),
}
SEARCH_OPERATORS = ["site:", "inurl:", "filetype:", "intitle:", "cache:"]
MOST_HYPOTHESIS_CHARS = 160
BASIS_STRENGTH = {"shared_page": 4, "canonical_url": 3, "attribute_match": 2, "name_only": 1}

#: What each angle of research adds to a node's queries.
ANGLES = {"current_employer_leadership": ["employer_team"], "past_employers": ["past_employers"], "board_or_advisory": ["governance"], "industry_peers": [], "generic": ["governance"]}

# --- providers, fixed values ---
#: Followed properties of an entity, in order, and how the target relates to it.
PROPERTIES = {"P26": "spouse of", "P22": "father of", "P25": "mother of", "P40": "parent of", "P3373": "sibling of", "P108": "employed by", "P1066": "student of", "P802": "taught", "P463": "member of"}
INSTANCE_OF, HUMAN, MOST_TARGETS = "P31", "Q5", 24
PROSE_FORMS = ["EX-99", "8-K", "S-1", "424B", "DEF 14A", "10-K", "20-F", "6-K"]
INSTITUTION_NOISE = "university universite college institute school of the and for center centre department dept lab laboratory hospital medical research national state system inc".split()
NONPROFIT_NOISE = "the of and for inc llc foundation trust institute association society center centre".split()
DOMAIN_NOISE = "the inc llc ltd corp corporation company co group holdings plc gmbh limited and".split()
TEAM_PATHS = ["/team", "/our-team", "/people", "/about/team", "/leadership", "/partners"]
TLDS = [".com", ".io", ".co", ".vc", ".org"]
ARTICLE_URL, ENTITY_URL = "https://en.wikipedia.org/wiki/", "https://www.wikidata.org/wiki/"
FILING_URL = "https://www.sec.gov/Archives/edgar/data/"
NONPROFIT_URL = "https://projects.propublica.org/nonprofits/organizations/"
COMPANY_URL = "https://opencorporates.com/companies/"
