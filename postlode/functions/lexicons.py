"""Word and pattern lists of the classifiers, over normalised lower-case text. Each is a parameter's default."""

SENIOR_TITLES = (
    r"\bsenior\b", r"\bsr\.?\b", r"\blead\b", r"\bprincipal\b", r"\bstaff\b", r"\bexpert\b", r"\barchitect\b", r"\bmanager\b",
    r"\bdirector\b", r"\bhead\b", r"\bchief\b", r"\bciso\b", r"\bvice president\b", r"\bvp\b", r"\bavp\b", r"\bmid[- ]level\b",
    r"\bmidlevel\b", r"\bexperienced\b", r"\blevel\s*[2-9]\b", r"\bl[2-9]\b", r"\bii\b", r"\biii\b", r"\biv\b", r"\bv\b",
    r"\b(?:engineer|developer|analyst|tester|scientist|administrator|specialist)\s*[2-9]\b",
)
NEGATIVE_TITLES = (
    r"\bsales\b", r"\bbusiness development\b", r"\baccount executive\b", r"\baccount manager\b", r"\bmarketing\b", r"\brecruiter\b",
    r"\brecruitment\b", r"\btalent acquisition\b", r"\bhuman resources\b", r"\bhr manager\b", r"\bfinance\b", r"\baccountant\b",
    r"\bpayroll\b", r"\bprocurement\b", r"\blegal\b", r"\bcustomer success\b", r"\bproduct manager\b", r"\bproject manager\b",
    r"\bprogram manager\b", r"\boperations manager\b",
)
HOME_PLACES = (
    "india", "hyderabad", "bengaluru", "bangalore", "pune", "mumbai", "chennai", "delhi", "new delhi", "gurugram", "gurgaon",
    "noida", "kolkata", "kochi", "coimbatore", "ahmedabad", "jaipur", "indore", "bhubaneswar", "chandigarh", "trivandrum",
    "thiruvananthapuram", "mysore", "mysuru",
)
FOREIGN_PLACES = (
    "united states", "united states of america", "usa", "u.s.", "canada", "united kingdom", "uk", "england", "scotland", "ireland",
    "germany", "france", "spain", "italy", "netherlands", "sweden", "norway", "denmark", "finland", "poland", "romania", "portugal",
    "australia", "new zealand", "singapore", "malaysia", "philippines", "indonesia", "japan", "south korea", "colombia", "mexico",
    "brazil", "argentina", "chile", "taiwan", "hong kong", "israel", "switzerland", "belgium", "austria",
)
GLOBAL_PLACES = (
    "global", "worldwide", "anywhere", "work from anywhere", "remote - international", "remote international", "international remote",
)
NEAR_PLACES = ("hyderabad", "india remote")
ENTRY_RANGE = r"\b0\s*[-–]\s*[1-3]\s*years?\b"
ENTRY_WORDS = (
    r"\bno experience\b", r"\bexperience not required\b", r"\bentry[- ]level\b", r"\bfresher\b", r"\brecent graduate\b",
    r"\bnew graduate\b", r"\bgraduate\b", r"\btrainee\b", r"\bjunior\b", r"\bapprentice\b", r"\bintern\b", r"\binternship\b",
)
STATED_YEARS = (r"\b[1-9]\s*[-–]\s*[2-9]\s*years?\b", r"\b(?:[2-9]|10)\+?\s*years?\b", r"\b[1-9]\s*years?\b")
REQUIRED_YEARS = (
    r"\brequir(?:e|es|ed|ing)\b[^.]{0,80}\b(?:at\s+least\s+)?[1-9]\s*\+?\s*years?\b",
    r"\bminimum\s+(?:of\s+)?[1-9]\s*\+?\s*years?\b",
    r"\b[1-9]\s*\+?\s*years?\s+(?:of\s+)?(?:experience|work experience)\b",
    r"\b[1-9]\s*[-–]\s*[2-9]\s*years?\s+(?:of\s+)?(?:experience|work experience)\b",
    r"\b10\s*\+?\s*years?\s+(?:of\s+)?(?:experience|work experience)\b",
    r"\b[1-9]\s*\+?\s*years?\b[^.]{0,30}\b(?:required|preferred|mandatory|minimum)\b",
)

#: Remote work, as a pre-filter reads it from title, location and description together.
SCREEN = {
    "worldwide": (
        r"\bworldwide\b", r"\bwork\s+from\s+anywhere\b", r"\bwork\s+anywhere\b", r"\banywhere\s+in\s+the\s+world\b",
        r"\banywhere\s+around\s+the\s+world\b", r"\bopen\s+to\s+applicants\s+worldwide\b", r"\bopen\s+to\s+candidates\s+worldwide\b",
        r"\bhiring\s+worldwide\b", r"\bhire\s+worldwide\b", r"\bglobal\s+remote\b", r"\bremote\s*[-–—]\s*worldwide\b",
        r"\bremote\s+worldwide\b", r"\bremote\s+anywhere\b", r"\bremote\s+from\s+anywhere\b", r"\bremote\s+from\s+any\s+country\b",
        r"\bany\s+country\b", r"\ball\s+countries\b", r"\binternational\s+applicants\b", r"\binternational\s+candidates\b",
        r"\bglobal\s+applicants\b", r"\bglobal\s+candidates\b",
    ),
    "home": (
        r"\bindia\b", r"\bremote\s*[-–—]\s*india\b", r"\bremote\s+india\b", r"\bindia\s*[-–—]\s*remote\b", r"\bwork\s+from\s+india\b",
        r"\bworking\s+from\s+india\b", r"\bhiring\s+in\s+india\b", r"\bhire\s+in\s+india\b", r"\bindia\s+eligible\b",
        r"\bindia\s+is\s+eligible\b", r"\bindian\s+applicants\b", r"\bindian\s+candidates\b",
    ),
    "remote": (
        r"\bremote\b", r"\bfully\s+remote\b", r"\b100%\s+remote\b", r"\bwork\s+from\s+home\b", r"\bwfh\b", r"\bdistributed\s+team\b",
        r"\bremote-first\b", r"\bremote\s+first\b", r"\bhome-based\b", r"\bhome\s+based\b",
    ),
    "office": (
        r"\bon[- ]site\b", r"\bonsite\b", r"\bin[- ]office\b", r"\bin\s+office\b", r"\boffice[- ]based\b",
        r"\bmust\s+work\s+from\s+office\b", r"\brequires\s+office\s+attendance\b", r"\bhybrid\b", r"\bhybrid\s+role\b",
        r"\bhybrid\s+position\b", r"\bhybrid\s+schedule\b",
    ),
    "country": (
        r"\bus\s+only\b", r"\busa\s+only\b", r"\bunited\s+states\s+only\b", r"\bremote\s*[-–—]\s*us\b", r"\bremote\s*\(\s*us\s*\)",
        r"\bremote\s+within\s+the\s+us\b", r"\bmust\s+reside\s+in\s+the\s+us\b", r"\bmust\s+be\s+located\s+in\s+the\s+us\b",
        r"\bcanada\s+only\b", r"\bremote\s*[-–—]\s*canada\b", r"\bmust\s+reside\s+in\s+canada\b", r"\buk\s+only\b",
        r"\bunited\s+kingdom\s+only\b", r"\bremote\s*[-–—]\s*uk\b", r"\beurope\s+only\b", r"\beu\s+only\b", r"\bremote\s*[-–—]\s*eu\b",
        r"\bremote\s*[-–—]\s*europe\b", r"\bemea\s+only\b", r"\bremote\s*[-–—]\s*emea\b", r"\bapac\s+only\b",
        r"\bremote\s*[-–—]\s*apac\b", r"\blatam\s+only\b", r"\bremote\s*[-–—]\s*latam\b",
    ),
    "not_home": (
        r"\bnot\s+available\s+in\s+india\b", r"\bnot\s+open\s+to\s+india\b", r"\bindia\s+not\s+eligible\b",
        r"\bindia\s+is\s+not\s+eligible\b", r"\bexcluding\s+india\b", r"\bexcept\s+india\b", r"\bno\s+hiring\s+in\s+india\b",
    ),
    "permit": (
        r"\bmust\s+be\s+authorized\s+to\s+work\s+in\s+the\s+us\b", r"\bmust\s+have\s+us\s+work\s+authorization\b",
        r"\bus\s+work\s+authorization\s+required\b", r"\bmust\s+have\s+the\s+right\s+to\s+work\s+in\s+the\s+us\b",
        r"\bwork\s+authorization\s+required\b", r"\bright\s+to\s+work\s+required\b", r"\bno\s+visa\s+sponsorship\b",
    ),
}

#: Remote work, as the verification of a page reads it.
VERIFY = {
    "remote": (r"\bremote\b", r"\bfully remote\b", r"\b100% remote\b", r"\bwork from home\b", r"\bwork[- ]from[- ]home\b", r"\bdistributed\b"),
    "office": (r"\bon[- ]site\b", r"\bonsite\b", r"\bin[- ]office\b", r"\bin office\b", r"\bhybrid\b", r"\bwork from office\b", r"\bwfo\b"),
    "worldwide": (
        r"\bworldwide\b", r"\bwork anywhere\b", r"\bwork from anywhere\b", r"\banywhere in the world\b", r"\bglobal remote\b",
        r"\bglobally remote\b", r"\bremote anywhere\b",
    ),
    "home": (
        r"\bremote from india\b", r"\bindia remote\b", r"\bremote[- ]india\b", r"\bremote in india\b", r"\bindia[- ]based remote\b",
        r"\bhire in india\b", r"\bhiring in india\b", r"\bopen to india\b", r"\bavailable in india\b",
    ),
    "country": (
        r"\bmust be based in\b", r"\bmust reside in\b", r"\bmust live in\b", r"\bresidents of\b", r"\bonly in\b", r"\bonly available in\b",
        r"\bavailable only in\b", r"\bremote -?us only\b", r"\bus only\b", r"\busa only\b", r"\bunited states only\b",
        r"\bcanada only\b", r"\buk only\b", r"\beurope only\b", r"\beu only\b",
    ),
    "permit": (
        r"\bauthorized to work in the united states\b", r"\bauthorized to work in the us\b", r"\bwork authorization in the us\b",
        r"\bwork authorization in the united states\b", r"\blegal right to work in the us\b", r"\bmust have us work authorization\b",
    ),
    "home_permit": (r"\bauthorized to work in india\b", r"\bright to work in india\b", r"\bindia work authorization\b"),
}
