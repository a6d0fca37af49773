"""Fixed values that catalogue rules need. Larger rule sets (taxonomy, attribute contracts) are parameters: see
`gristmill.sources.rules`."""

from __future__ import annotations

from typing import NamedTuple


def _pairs(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (line.partition(" =") for line in text.strip().splitlines())}


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.replace("\n", " ").split(", ") if w.strip())


class Unit(NamedTuple):
    canonical: str
    family: str
    fractional: bool
    scan_excluded: bool
    aliases: tuple[str, ...]


#: Trade shorthand and its full form.
EXPANSIONS = _pairs("""
ss = Stainless Steel
sst = Stainless Steel
sts = Stainless Steel
bss = Black Stainless Steel
stl = Steel
alum = Aluminum
al = Aluminum
brs = Brass
cu = Copper
pvc = PVC
cpvc = CPVC
abs = ABS
galv = Galvanized
gi = Galvanized Iron
ci = Cast Iron
poly = Polyethylene
nyl = Nylon
rbr = Rubber
cer = Ceramic
prc = Porcelain
chr = Chrome
blk = Black
bk = Black
wh = White
wht = White
biscuit = Biscuit
alm = Almond
bz = Bronze
orb = Oil Rubbed Bronze
sn = Satin Nickel
bn = Brushed Nickel
pn = Polished Nickel
pb = Polished Brass
clr = Clear
frst = Frosted
lt = Light
lts = Lights
lgt = Light
fixt = Fixture
flor = Fluorescent
fluor = Fluorescent
incan = Incandescent
hal = Halogen
led = LED
cfl = CFL
hid = HID
bulb = Bulb
lamp = Lamp
recep = Receptacle
rcpt = Receptacle
sw = Switch
swtch = Switch
brkr = Breaker
cb = Circuit Breaker
pnl = Panel
encl = Enclosure
cond = Conduit
conn = Connector
term = Terminal
wr = Wire
cbl = Cable
crd = Cord
elect = Electric
elec = Electric
el = Electric
gas = Gas
dw = Dishwasher
ref = Refrigerator
fridge = Refrigerator
frzr = Freezer
wshr = Washer
dryr = Dryer
mw = Microwave
mwo = Microwave Oven
rng = Range
ckt = Cooktop
wall ov = Wall Oven
ov = Oven
hd = Hood
dsps = Disposer
cutoff = Cut Off
grnd = Grinding
grndr = Grinder
abr = Abrasive
snd = Sanding
sndr = Sander
blde = Blade
bld = Blade
bit = Bit
drl = Drill
hmr = Hammer
impct = Impact
drvr = Driver
wrnch = Wrench
scrw = Screw
chgr = Charger
batt = Battery
cordless = Cordless
recip = Reciprocating
circ = Circular
osc = Oscillating
pnl'd = Panel
lvl = Laminated Veneer Lumber
osb = Oriented Strand Board
ply = Plywood
trtd = Treated
pt = Pressure Treated
kd = Kiln Dried
sq = Square
sq edge = Square Edge
grvd = Grooved
prmd = Primed
unfin = Unfinished
mldg = Molding
trm = Trim
dck = Decking
od = Outside Diameter
id = Inside Diameter
dia = Diameter
thk = Thickness
lg = Length
wd = Width
ht = Height
dp = Depth
mnt = Mounting
mtg = Mounting
bltln = Built-in
bltin = Built-in
fs = Free Standing
slidein = Slide-in
undrmnt = Undermount
surf = Surface
flsh = Flush
semiflsh = Semi-Flush
pend = Pendant
chand = Chandelier
sconce = Sconce
recsd = Recessed
ext = Exterior
int = Interior
indr = Indoor
outdr = Outdoor
asy = Assembly
assy = Assembly
kit = Kit
repl = Replacement
accy = Accessory
adj = Adjustable
hd duty = Heavy Duty
hvy = Heavy
lt duty = Light Duty
std = Standard
univ = Universal
compl = Complete
prof = Professional
comm = Commercial
resid = Residential
indus = Industrial
ser = Series
srs = Series
mdl = Model
no = Number
qty = Quantity
ea = Each
""")

#: Shorthand for brands.
BRAND_SHORTHAND = _pairs("""
milw = Milwaukee
milwaukee = Milwaukee
dewlt = DEWALT
dewalt = DEWALT
dw = DEWALT
mkta = Makita
makita = Makita
bosch = Bosch
diablo = Diablo
freud = Freud
festool = Festool
kreg = Kreg
grizzly = Grizzly
jet = JET
satco = Satco
kichler = Kichler
philips = Philips
phillips = Philips
trex = Trex
timbertech = TimberTech
azek = AZEK
hardie = James Hardie
hardiepanel = James Hardie
hardieplank = James Hardie
leviton = Leviton
southwire = Southwire
lutron = Lutron
frigidaire = Frigidaire
whirlpool = Whirlpool
maytag = Maytag
kitchenaid = KitchenAid
lg = LG
samsung = Samsung
bosch appl = Bosch
ge = GE
speed queen = Speed Queen
sq = Speed Queen
element = Element
mirka = Mirka
edge = Edge Eyewear
vessel = Vessel
hunter = Hunter Fan
square d = Square D
3m = 3M
""")

#: Full forms and their invoice abbreviations.
INVOICE = _pairs("""
stainless steel = SST
black stainless steel = BSST
built-in = BLTLN
built in = BLTLN
free standing = FRSTD
freestanding = FRSTD
slide-in = SLDIN
under counter = UNDCTR
undermount = UNDMT
surface mount = SURFMT
flush mount = FLSHMT
semi-flush = SEMIFL
wall mount = WALLMT
ceiling mount = CLGMT
professional series = PRO SER
professional = PRO
commercial = COMM
residential = RES
industrial = IND
heavy duty = HD
light duty = LD
adjustable = ADJ
aluminum = ALUM
galvanized = GALV
polished chrome = PCHR
brushed nickel = BRSNKL
satin nickel = SATNKL
oil rubbed bronze = ORB
matte black = MTBLK
black = BLK
white = WHT
almond = ALM
biscuit = BISC
bisque = BISQ
chrome = CHR
bronze = BRZ
brass = BRS
nickel = NKL
copper = CU
cast iron = CI
steel = STL
plastic = PLAS
rubber = RBR
ceramic = CER
porcelain = PRC
refrigerator = REFRIG
dishwasher = DISHWASHER
microwave = MICROWAVE
washer = WASHER
dryer = DRYER
electric = ELEC
cordless = CRDLS
reciprocating = RECIP
circular = CIRC
oscillating = OSC
fluorescent = FLUOR
incandescent = INCAN
receptacle = RECEP
circuit breaker = CB
load center = LDCTR
cut off = CUTOFF
grinding = GRND
sanding = SND
abrasive = ABR
assembly = ASY
replacement = REPL
accessory = ACCY
universal = UNIV
standard = STD
number of = 
with = W/
without = W/O
and = &
square = SQ
diameter = DIA
thickness = THK
length = LG
width = WD
height = HT
depth = DP
mounting = MNT
exterior = EXT
interior = INT
outdoor = OUTDR
indoor = INDR
""")

#: Units as canonical | family | flags | aliases.
_UNIT_LINES = """
in | length | fractional | " ; in. ; inch ; inches ; ” ; ″ ; ''
ft | length | fractional | ' ; ft. ; foot ; feet ; ’
yd | length |  | yd. ; yard ; yards
mm | length |  | mm. ; millimeter ; millimetre ; millimeters
cm | length |  | cm. ; centimeter ; centimeters
m | length | scan_excluded | m. ; meter ; metre ; meters
V | voltage |  | v ; v. ; volt ; volts ; vac ; vdc
A | current |  | a ; a. ; amp ; amps ; ampere ; amperes
mA | current |  | ma ; milliamp ; milliamps
W | power |  | w ; w. ; watt ; watts
kW | power |  | kw ; kilowatt ; kilowatts
kW-hr | energy |  | kwh ; kw-hr ; kilowatt hour ; kilowatt-hour
HP | power |  | hp ; hp. ; horsepower ; h.p.
Hz | frequency |  | hz ; hertz ; cycle ; cycles
ohm | resistance |  | ohms ; Ω
AWG | wire gauge |  | awg ; ga ; gauge ; ga.
kcmil | wire gauge |  | kcmil ; mcm
K | color temperature |  | k ; kelvin
lm | luminous flux |  | lm ; lumen ; lumens
cd | luminous intensity | scan_excluded | cd ; candela
fc | illuminance |  | fc ; foot-candle ; footcandle
CRI | color rendering |  | cri
RPM | rotational speed |  | rpm ; r.p.m. ; rev/min
SPM | stroke rate |  | spm ; strokes/min
SFPM | surface speed |  | sfpm ; sfm ; ft/min
lb | weight |  | lb. ; lbs ; lbs. ; pound ; pounds ; #
oz | weight |  | oz. ; ounce ; ounces
kg | weight |  | kg. ; kilogram ; kilograms
g | weight | scan_excluded | gram ; grams
lb-ft | torque |  | lb-ft ; ft-lb ; ft.lb ; foot-pound
in-lb | torque |  | in-lb ; inch-pound ; in.lb
Nm | torque |  | nm ; newton-meter ; newton meter
gal | volume |  | gal. ; gallon ; gallons
qt | volume |  | qt. ; quart ; quarts
pt | volume | scan_excluded | pt. ; pint ; pints
fl oz | volume |  | fl. oz. ; fl oz. ; fluid ounce ; fluid ounces
L | volume | scan_excluded | l ; liter ; litre ; liters
mL | volume |  | ml ; milliliter ; millilitre
cu ft | volume |  | cu. ft. ; cuft ; ft3 ; cubic foot ; cubic feet
cu in | volume |  | cu. in. ; cuin ; in3 ; cubic inch ; cubic inches
gpm | flow rate |  | g.p.m. ; gal/min ; gallons per minute
CFM | air flow |  | cfm ; c.f.m. ; ft3/min
psi | pressure |  | p.s.i. ; lb/in2 ; pounds per square inch
bar | pressure |  | bars
sq ft | area |  | sq. ft. ; sqft ; ft2 ; square foot ; square feet
sq in | area |  | sq. in. ; sqin ; in2 ; square inch ; square inches
BTU | heat |  | btu ; b.t.u. ; btus
dBA | sound level |  | dba ; db(a) ; decibel ; decibels ; db
degF | temperature | scan_excluded | f ; °f ; deg f ; fahrenheit
degC | temperature | scan_excluded | c ; °c ; deg c ; celsius ; centigrade
hr | time |  | hr. ; hrs ; hour ; hours
min | time |  | min. ; mins ; minute ; minutes
sec | time |  | sec. ; secs ; second ; seconds
yr | time |  | yr. ; yrs ; year ; years
pc | count |  | pc. ; pcs ; piece ; pieces ; pct
pk | count |  | pk. ; pack ; packs ; pkg
ea | count |  | each
bx | count |  | box ; boxes
cs | count |  | case ; cases
rl | count |  | roll ; rolls
bdl | count |  | bundle ; bundles
pr | count |  | pair ; pairs
st | count | scan_excluded | set ; sets
grit | abrasive grade |  | grit ; grits
TPI | tooth pitch |  | tpi ; teeth per inch
T | tooth count | scan_excluded | tooth ; teeth
PH | electrical phase |  | ph ; phase
"""

#: Brands and the legal entity behind them.
LEGAL_ENTITIES = _pairs("""
3m = 3M Company
amana = Whirlpool Corporation
azek = The AZEK Company Inc
bosch = Robert Bosch Tool Corporation
dewalt = Stanley Black & Decker Inc
diablo = Freud America Inc
dremel = Robert Bosch Tool Corporation
feit electric = Feit Electric Company Inc
festool = Festool USA
first alert = Resideo Technologies Inc
frigidaire = Electrolux Home Products Inc
ge = GE Appliances
grizzly = Grizzly Industrial Inc
hager = Hager Companies
hunter = Hunter Fan Company
hunter fan = Hunter Fan Company
irwin = Stanley Black & Decker Inc
james hardie = James Hardie Building Products Inc
jameshardie = James Hardie Building Products Inc
jet = JPW Industries Inc
kichler = Kichler Lighting LLC
kitchenaid = Whirlpool Corporation
kreg = Kreg Tool Company
leviton = Leviton Manufacturing Co Inc
lg = LG Electronics Inc
lp smartside = Louisiana-Pacific Corporation
lutron = Lutron Electronics Co Inc
makita = Makita Corporation of America
maytag = Whirlpool Corporation
milwaukee = Milwaukee Electric Tool Corporation
mirka = Mirka Ltd
philips = Signify North America Corporation
provia = ProVia LLC
samsung = Samsung Electronics America Inc
satco = Satco Products Inc
senco = Kyocera Senco Industrial Tools Inc
southwire = Southwire Company LLC
speed queen = Alliance Laundry Systems LLC
square d = Schneider Electric USA Inc
timbertech = The AZEK Company Inc
trex = Trex Company Inc
velux = VELUX America LLC
vessel = Vessel Industrial Tools Co Ltd
whirlpool = Whirlpool Corporation
""")

#: Brands that carry the registered mark.
REGISTERED = _words("""
3m, amana, azek, bosch, dewalt, diablo, dremel, feit electric, festool, first alert, frigidaire, ge, grizzly, hager, hunter, hunter fan, irwin, james hardie, jameshardie, jet, kichler, kitchenaid, kreg, leviton, lg, lp smartside, lutron, makita, maytag, milwaukee, mirka, philips, provia, rheem, samsung, satco, senco, southwire, speed queen, square d, timbertech, trex, velux, vessel, whirlpool
""")

#: Words that never name a brand.
NEVER_BRAND = _words("""
the, and, for, with, without, new, old, each, per, kit, set, pack, box, case, roll, pair, assembly, only, display, model, series, type, size, color, colour, left, right, front, back, upper, lower, inner, outer, small, medium, large, long, short, wide, narrow, deep, black, white, brown, grey, gray, silver, gold, clear
""")

#: Words that end an account name without being part of a brand.
ACCOUNT_SUFFIXES = _words("""
cooperative, coop, co-op, accessory, accessories, incorporated, inc, llc, llp, ltd, limited, plc, corporation, corp, company, co, holdings, group, manufacturing, mfg, products, product, prod, industries, industrial, intl, international, supply, supplies, distribution, distributors, dist, lighting, electric, electrical, tools, tool, usa, us, america, american, north, division, div, dv, sales, systems, solutions, building, materials, lumber, metals, gear
""")

#: Product address patterns by brand.
URL_TEMPLATES = _pairs("""
frigidaire = https://www.frigidaire.com/en/p/owner-center/product-support/{mpn}
whirlpool = https://learnwhirlpool.com/smartsearchresults?searchtext={mpn}
maytag = https://www.maytag.com/search?Ntt={mpn}
kitchenaid = https://www.kitchenaid.com/search?Ntt={mpn}
milwaukee = https://www.milwaukeetool.com/Products/Search?q={mpn}
dewalt = https://www.dewalt.com/search?q={mpn}
makita = https://www.makitatools.com/products/search?q={mpn}
festool = https://www.festoolusa.com/search?q={mpn}
diablo = https://www.diablotools.com/search?q={mpn}
trex = https://www.trex.com/search/?q={mpn}
timbertech = https://www.timbertech.com/search/?q={mpn}
azek = https://www.azekexteriors.com/search/?q={mpn}
kichler = https://www.kichler.com/search?q={mpn}
satco = https://www.satco.com/searchresults?q={mpn}
philips = https://www.usa.lighting.philips.com/search?q={mpn}
leviton = https://www.leviton.com/en/products/{mpn}
southwire = https://www.southwire.com/search?q={mpn}
square d = https://www.se.com/us/en/product/{mpn}/
lutron = https://www.lutron.com/en-US/pages/searchresults.aspx?k={mpn}
james hardie = https://www.jameshardie.com/search?q={mpn}
jameshardie = https://www.jameshardie.com/search?q={mpn}
velux = https://www.veluxusa.com/search?q={mpn}
grizzly = https://www.grizzly.com/search/{mpn}
kreg = https://www.kregtool.com/search?q={mpn}
dremel = https://www.dremel.com/us/en/search?q={mpn}
""")

UNITS = tuple(
    Unit(name.strip(), family.strip(), "fractional" in flags, "scan_excluded" in flags, tuple(a.strip() for a in aliases.split(" ; ") if a.strip()))
    for name, family, flags, aliases in (line.split(" | ") for line in _UNIT_LINES.strip().splitlines())
)

#: Columns of the input, in order.
PASSTHROUGH = ("Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf")

#: Columns no input can give, and who keeps them.
NOT_DERIVABLE = _pairs("""
PART_NUMBER = distributor ERP item master
SKU - MY_PART_NUMBER = distributor ERP SKU master
List Price = distributor pricing system / manufacturer price file
UPC = GS1 registry or manufacturer packaging data
EAN = GS1 registry or manufacturer packaging data
GTIN = GS1 registry or manufacturer packaging data
Country Of Origin = manufacturer compliance documentation
Selling Qty = distributor ERP unit-of-sale configuration
Prop 65 = manufacturer compliance documentation
MTR = manufacturer mill test report
""")

#: Present but empty, lower case.
PLACEHOLDERS = ("-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "commodity - unbranded", "unbranded", "no brand", "no unilog brand", "no dib brand", "no e1 brand", "n/a", "na", "none", "null", "-", "--", "---", ".", "?", "tbd", "unknown", "misc", "miscellaneous", "generic")

#: Marks of the listing, not the product.
NOISE = ("display only", "display model", "floor model", "clearance", "discontinued", "special order", "do not order", "obsolete", "linear foot", "per foot", "cut to length")

#: Title words kept low, and acronyms kept up.
LOWER_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with")
UPPER_WORDS = ("LED", "CFL", "HID", "PVC", "CPVC", "ABS", "SST", "GFCI", "AFCI", "USB", "AC", "DC", "UL", "CSA", "NSF", "ASSE", "ADA", "MDF", "OSB", "LVL", "HP", "RPM", "TPI", "AWG", "BTU", "CFM", "NEMA", "IP", "3M", "LG", "GE", "II", "III", "IV", "XL", "XXL")

#: Certification marks and the words that show them.
APPROVALS = _pairs("""
ADA Compliant = ada
ASSE 1006 = asse
CEE Tier 2 Qualified = cee tier
CSA Certified = csa
ENERGY STAR Certified = energy star|estar
ETL Listed = etl
FCC Compliant = fcc
NSF Certified = nsf
UL Listed = ul listed|ul-listed
WaterSense Certified = watersense
cUL Listed = cul
cETL Listed = cetl
""")

#: Expansions that count as colours or materials.
FINISHES = ("Black", "White", "Stainless Steel", "Black Stainless Steel", "Almond", "Bronze", "Brass", "Chrome", "Clear", "Aluminum", "Steel", "Copper", "Nickel", "Satin Nickel", "Brushed Nickel", "Polished Nickel", "Polished Brass", "Oil Rubbed Bronze")

#: Trust in a cell by its source.
SOURCE_WEIGHTS = {"input_copy": 1.00, "lexicon_exact": 0.98, "regex_extract": 0.95, "constraint_solver": 0.95, "crosswalk": 0.92, "derived": 0.90, "lexicon_fuzzy": 0.85, "local_model": 0.60, "llm": 0.50, "contract_template": 0.0, "not_derivable": 0.0, "placeholder_dropped": 0.0, "unresolved": 0.0}

#: Thresholds of the learning and scoring rules.
MIN_COVERAGE, MAX_GROUPS, MIN_SALIENCE, LINK_THRESHOLD, MIN_PREFIX = 0.25, 3, 0.08, 82, 4
BRAND_PURITY, BRAND_ROWS = 0.60, 3
BOOST, PRIOR, PRIOR_ONLY_PURITY, PRIOR_ONLY_WEIGHT, LEARN = 0.18, 0.35, 0.60, 5.0, 0.70
AUTO, BLOCKED, REVIEW = 0.85, 0.45, 0.70
INVOICE_MAX, MOBILE_MIN, MOBILE_MAX = 40, 60, 80
#: The ratio from which an account's head is a brand's name.
HEAD_RATIO = 88
