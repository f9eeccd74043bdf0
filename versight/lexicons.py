"""Word lists, templates and weights.

Fixed values: results depend on these exact words, patterns and numbers, so they are
stated as plain text. Every operator takes its lexicon as a parameter.
"""

CHARACTERS = ("Thalcave", "Faria", "Kai-Koumou", "Noirtier", "Tom Ayrton", "Ben Joyce", "Jacques Paganel")


EVENTS = {
    "custody": ("arrest", "arrested", "captured", "captive", "captivity", "confined", "imprisoned", "imprisonment", "prison", "dungeon", "cell", "detained", "prisoner"),
    "captivity": ("arrest", "arrested", "captured", "captive", "imprisoned", "imprisonment", "prison", "dungeon", "cell", "detained"),
    "escape": ("escape", "escaped", "fled", "flight", "slipped away", "liberated"),
    "escape_release": ("escape", "escaped", "released", "freed", "liberated", "no longer prisoner"),
    "movement": ("travelled", "traveled", "journeyed", "sailed", "arrived", "departed", "left", "went", "returned", "came", "rode", "walked", "marched"),
    "public_appearance": ("appeared", "attended", "joined", "met", "visited", "presented", "assembly", "public"),
    "later_action": ("later", "afterwards", "subsequently", "returned", "spoke", "wrote", "confessed", "appeared"),
    "death": ("died", "dead", "death", "killed", "murdered", "poisoned", "executed", "slain"),
    "betrayal": ("betray", "betrayed", "treason", "traitor", "denounced", "informer"),
    "violence": ("attack", "attacked", "killed", "murdered", "stabbed", "shot", "wounded", "poisoned"),
    "rescue": ("rescue", "rescued", "saved", "delivered", "freed"),
    "voyage": ("voyage", "sailed", "ship", "aboard", "coast", "sea", "journey", "travelled", "traveled"),
    "political_intrigue": ("conspiracy", "plot", "royalist", "bonapartist", "minister", "procureur", "spy"),
    "family_relationship": ("father", "mother", "son", "daughter", "sister", "brother", "married", "betrothed"),
    "identity_secret": ("disguise", "alias", "secret", "hidden", "unknown", "revealed", "confessed"),
    "wealth_property": ("treasure", "fortune", "inheritance", "property", "estate", "money"),
}
TEMPORAL = ("before", "after", "later", "earlier", "then", "when", "while", "during", "soon", "once", "years", "months", "days", "night", "morning", "evening")
TEMPORAL_CUES = ("before", "after", "later", "earlier", "then", "during", "afterwards", "subsequently", "returned")
SPEECH = ("said", "replied", "asked", "answered", "cried", "exclaimed", "whispered")

#: Event type -> (categories, terms) that signal it in a chunk.
SIGNALS = {
    "custody": (("custody", "captivity"), ("imprisoned", "prison", "cell", "dungeon", "captive", "prisoner")),
    "captivity": (("custody", "captivity"), ("imprisoned", "prison", "cell", "dungeon", "captive", "prisoner")),
    "escape": (("escape", "escape_release"), ("escape", "escaped", "fled", "flight")),
    "escape_release": (("escape", "escape_release", "rescue"), ("escaped", "released", "freed", "liberated", "no longer prisoner")),
    "movement": (("movement", "voyage"), ("travelled", "traveled", "arrived", "departed", "sailed", "went", "journey", "returned", "rode")),
    "voyage": (("movement", "voyage"), ("voyage", "sailed", "ship", "aboard", "journey")),
    "public_appearance": (("public_appearance",), ("appeared", "attended", "joined", "met", "visited", "public", "assembly")),
    "later_action": (("later_action", "public_appearance", "movement"), ("later", "afterwards", "subsequently", "spoke", "met", "wrote", "returned", "appeared")),
    "death": (("death", "violence"), ("died", "dead", "death", "killed", "murdered", "poisoned", "executed")),
    "violence": (("death", "violence"), ("attack", "attacked", "killed", "murdered", "wounded", "poisoned")),
    "marriage_relationship": (("family_relationship",), ("married", "wife", "husband", "wedding", "betrothed", "marriage")),
    "betrayal_deception": (("betrayal", "political_intrigue"), ("betrayed", "treason", "traitor", "denounced", "spy")),
    "rescue_help": (("rescue",), ("rescued", "saved", "helped", "protected", "warned")),
    "loyalty_help": (("rescue",), ("loyal", "helped", "protected", "saved", "warned")),
    "knowledge_secret": (("identity_secret",), ("secret", "learned", "discovered", "revealed", "confessed")),
    "later_discovery": (("identity_secret",), ("later", "discovered", "learned", "revealed")),
    "identity_alias": (("identity_secret",), ("alias", "disguise", "identity", "unknown")),
    "possession_document": (("wealth_property",), ("document", "letter", "map", "dossier", "paper", "treasure")),
    "document_conflict": (("wealth_property",), ("lost", "found", "document", "letter", "map", "dossier")),
    "incompatible_location": (("voyage",), ("elsewhere", "place", "arrived", "departed", "at the same time")),
    "incompatible_time": ((), ("before", "after", "later", "earlier", "subsequently")),
    "direct_negation": ((), ("not", "never", "false", "instead", "contrary")),
}

#: Claim types in the order in which they are tried.
CLAIM_TERMS = {
    "death_status": ("died", "dead", "death", "killed", "murdered", "slain", "poisoned", "executed"),
    "custody_status": ("imprisoned", "imprison", "prison", "captive", "captivity", "confined", "cell", "dungeon", "arrested", "re-arrested"),
    "relationship_marriage": ("married", "marriage", "wife", "husband", "betrothed", "wedding", "spouse"),
    "betrayal_deception": ("betrayed", "betrayal", "treason", "traitor", "deceived", "denounced", "spy", "informer"),
    "identity_alias": ("alias", "disguise", "identity", "secretly known", "assumed name", "renamed"),
    "knowledge_secret": ("knew", "learned", "discovered", "secret", "revealed", "confessed", "knowledge"),
    "possession_document": ("document", "letter", "map", "dossier", "will", "paper", "message", "note", "treasure"),
    "rescue_help": ("rescued", "saved", "helped", "aided", "protected", "freed"),
    "movement_location": ("travelled", "traveled", "journeyed", "sailed", "arrived", "departed", "left", "went", "moved", "lived", "stayed", "returned", "appeared", "attended", "joined", "met"),
}
#: Claim type -> (expected event types, incompatible event types).
CLAIM_EVENTS = {
    "custody_status": (("custody", "captivity"), ("escape_release", "escape", "movement", "voyage", "public_appearance", "later_action")),
    "death_status": (("death", "violence"), ("movement", "voyage", "public_appearance", "later_action", "marriage_relationship", "knowledge_secret")),
    "movement_location": (("movement", "voyage", "public_appearance"), ("incompatible_location", "incompatible_time")),
    "relationship_marriage": (("marriage_relationship", "family_relationship"), ("incompatible_relationship",)),
    "betrayal_deception": (("betrayal_deception",), ("rescue_help", "loyalty_help")),
    "identity_alias": (("identity_alias",), ("public_identity_conflict",)),
    "knowledge_secret": (("knowledge_secret",), ("prior_knowledge", "later_discovery")),
    "possession_document": (("possession_document",), ("document_conflict",)),
    "rescue_help": (("rescue_help",), ("betrayal_deception", "abandonment")),
    "generic": (("generic",), ("direct_negation",)),
}
#: Claim type -> states that a true claim excludes; {c} is the character.
STATES = {
    "custody_status": ("{c} escapes confinement", "{c} is released", "{c} travels freely", "{c} appears publicly elsewhere", "{c} attends or joins events", "{c} lives outside prison"),
    "death_status": ("{c} speaks later", "{c} travels later", "{c} meets someone later", "{c} appears publicly later", "{c} returns later", "{c} performs actions after supposed death"),
    "relationship_marriage": ("{c} is unmarried", "{c} marries someone else", "{c} rejects or breaks the engagement"),
    "betrayal_deception": ("{c} remains loyal", "{c} rescues or helps the alleged victim", "{c} protects rather than betrays"),
    "knowledge_secret": ("{c} learns the secret later", "{c} is surprised by a later discovery", "{c} lacks prior knowledge"),
    "possession_document": ("{c} lacks the document", "someone else possesses the document", "the document is discovered elsewhere"),
    "movement_location": ("{c} is somewhere incompatible at the same time", "{c} arrives or departs on a conflicting timeline"),
    "generic": ("evidence contradicts the claim about {c}",),
}
#: Claim type -> support queries; {b} is the book.
SUPPORT = {
    "custody_status": ("{c} imprisoned prison cell dungeon", "{c} captivity confined"),
    "death_status": ("{c} died dead killed death", "{c} murder execution poisoned"),
    "movement_location": ("{c} travelled arrived departed returned", "{c} appeared attended met joined"),
    "relationship_marriage": ("{c} married wife husband betrothed wedding", "{c} relationship marriage {b}"),
    "betrayal_deception": ("{c} betrayed treason deception denounced", "{c} traitor spy informer"),
}
#: Claim type -> further families of contradictions: (name, query, event types).
FAMILIES = {
    "custody_status": (
        ("free_activity_during_custody", "{c} escaped released travelled arrived departed attended appeared met lived outside joined others", ("escape_release", "movement", "public_appearance")),
        ("incompatible_status", "{c} free released no longer prisoner outside prison", ("escape_release", "status_free")),
    ),
    "death_status": (
        ("later_alive_after_death", "{c} spoke met travelled appeared married confessed wrote returned", ("movement", "public_appearance", "later_action", "knowledge_secret")),
        ("incompatible_time", "{c} later afterwards subsequently returned appeared alive", ("incompatible_time", "later_action")),
    ),
    "movement_location": (
        ("incompatible_location", "{c} elsewhere another place same time location", ("movement", "incompatible_location")),
        ("incompatible_time", "{c} before after later earlier arrived departed timeline", ("movement", "incompatible_time")),
    ),
    "relationship_marriage": (("incompatible_relationship", "{c} unmarried married someone else engagement broken refused", ("marriage_relationship", "incompatible_relationship")),),
    "knowledge_secret": (("prior_knowledge_vs_later_discovery", "{c} discovered learned later surprised secret revealed confessed", ("knowledge_secret", "later_discovery")),),
    "betrayal_deception": (("loyalty_vs_betrayal", "{c} loyal helped rescued protected saved warned", ("rescue_help", "loyalty_help")),),
    "possession_document": (("possession_or_document_conflict", "{c} document letter map dossier lost found by someone else", ("possession_document", "document_conflict")),),
}
STOP_WORDS = ("the", "and", "that", "with", "from", "into", "were", "was", "his", "her", "for", "but")
#: Token -> bucket of the hashed embedding.
SYNONYMS = {
    **dict.fromkeys(("imprisoned", "imprisonment", "prison", "dungeon", "cell", "captive", "captivity", "confined", "confinement"), "custody"),
    **dict.fromkeys(("escaped", "escape", "released", "freed"), "escape"),
    **dict.fromkeys(("travelled", "traveled", "arrived", "departed", "returned"), "movement"),
    **dict.fromkeys(("appeared", "public", "met"), "appearance"),
}
#: Weights of the hybrid score.
WEIGHTS = {"bm25": 0.38, "semantic": 0.18, "character": 0.15, "event": 0.14, "incompatible": 0.07, "density": 0.05, "temporal": 0.03}

ANCHOR_CHARACTERS = ("Faria", "Noirtier", "Thalcave", "Kai-Koumou", "Tom Ayrton", "Ayrton", "Ben Joyce", "Jacques Paganel", "Paganel", "Lord Glenarvan", "Lady Glenarvan", "Captain Grant", "Mary Grant", "Robert Grant", "Edmond Dantès", "Edmond Dantes", "Edmond", "Villefort", "Mercédès", "Mercedes", "Fernand", "Danglars", "Caderousse")
LOCATIONS = ("Château d’If", "Chateau d'If", "Chāteau d’If", "London", "Patagonia", "New Zealand", "Tasmania", "Madeira", "Toulon", "Lisbon", "Vienna", "Elba", "Waterloo", "South America", "South-American", "Marseille", "Marseilles")
INSTITUTIONS = ("Britannia", "Duncan", "Royal Geographical Society", "Geographical Society of Paris", "Girondins", "Bonapartist", "slave-traders", "slave traders")
ROLES = ("first mate", "quartermaster", "guide", "secretary", "abbé", "abbe", "chief", "captain", "procureur", "royalist", "Bonapartist")
OBJECTS = ("dossier", "letter", "map", "treasure", "Spada", "dagger", "forearm", "shark-tooth necklace", "battle-axe", "logbook", "document")
VERB_GROUPS = {
    "custody": ("arrested", "re-arrested", "imprisoned", "confined", "captured", "detained", "shipped"),
    "escape_release": ("escaped", "released", "freed", "slipped", "fled"),
    "movement": ("met", "travelled", "traveled", "arrived", "departed", "returned", "sailed", "boarded", "hired"),
    "violence": ("killed", "slashed", "stabbed", "wounded", "poisoned", "murdered"),
    "knowledge": ("knew", "learned", "discovered", "revealed", "studied"),
    "relationship": ("married", "argued", "rescued", "protected", "betrayed"),
}
CANONICAL = {
    "Ayrton": "Tom Ayrton",
    "Tom Ayrton Ben Joyce": "Tom Ayrton/Ben Joyce",
    "Ben Joyce": "Tom Ayrton/Ben Joyce",
    "Paganel": "Jacques Paganel",
    "Edmond": "Edmond Dantès",
    "Edmond Dantes": "Edmond Dantès",
    "Mercedes": "Mercédès",
}
#: Incompatible event type -> event types of frames that count as it.
EVENT_ALIASES = {
    "movement": ("voyage", "movement"),
    "escape_release": ("escape", "rescue", "escape_release"),
    "public_appearance": ("public_appearance", "voyage", "family_relationship"),
    "marriage_relationship": ("family_relationship", "marriage_relationship"),
    "knowledge_secret": ("identity_secret", "knowledge_secret"),
    "rescue_help": ("rescue", "rescue_help"),
    "loyalty_help": ("rescue", "loyalty_help"),
    "death": ("violence", "death"),
    "custody": ("captivity", "custody"),
}
#: Event lemmas and the forms that stand for them as substrings.
EVENT_FORMS = {
    "arrest": ("arrest", "arrested", "re-arrested", "detained"),
    "imprison": ("imprison", "imprisoned", "prison", "cell", "dungeon"),
    "ship": ("ship", "shipped", "transported", "sent to", "aboard"),
    "kill": ("kill", "killed", "murder", "murdered", "slain", "cut his throat"),
    "drown": ("drown", "drowned", "drowning"),
    "burn": ("burn", "burned", "burnt", "set fire"),
    "poison": ("poison", "poisoned"),
    "escape": ("escape", "escaped", "fled", "slipped away"),
    "marry": ("marry", "married", "wed", "betrothal"),
    "trial": ("trial", "court", "prosecuted"),
    "seize": ("seize", "seized", "confiscated"),
    "rescue": ("rescue", "rescued", "saved"),
    "raid": ("raid", "raided"),
    "smuggle": ("smuggle", "smuggled"),
    "betray": ("betray", "betrayed", "treason"),
    "execute": ("execute", "executed", "guillotined"),
    "transport": ("transported", "deported", "exiled"),
    "meet": ("met", "meeting"),
    "confess": ("confess", "confessed"),
}
#: Event types and terms of chunks that may contradict a custody or a death claim.
INCOMPATIBLE_HITS = {
    "custody_status": (
        ("escape", "rescue", "voyage", "movement", "escape_release", "public_appearance"),
        ("escaped", "escape", "released", "freed", "travelled", "traveled", "arrived", "departed", "appeared", "attended", "joined", "met"),
    ),
    "death_status": (
        ("voyage", "movement", "public_appearance", "later_action", "knowledge_secret"),
        ("later", "afterwards", "subsequently", "spoke", "met", "travelled", "traveled", "appeared", "returned", "wrote"),
    ),
}
#: Columns of a predictions file.
PREDICTION_COLUMNS = ("id", "book_name", "character", "predicted_label", "internal_status", "num_claims", "num_supported", "num_contradicted", "num_insufficient", "error", "decision_mode", "decision_score")
LABELS = ("consistent", "contradict")
COLUMN_ALIASES = {
    "id": ("id", "story_id", "example_id"),
    "book_name": ("book_name",),
    "character": ("character", "characters", "char"),
    "content": ("backstory", "content"),
    "caption": ("caption",),
    "label": ("label",),
}
