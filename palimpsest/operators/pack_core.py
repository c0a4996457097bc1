"""The built-in lexical pack: report-only terms, one list per rule, as (id, level, terms). Fixed values."""

PACK = (
    (
        "lexical.overused-verbs",
        "standard",
        (
            "delve", "delves", "delved", "leverage", "utilize", "harness", "streamline", "underscore", "underscores",
            "underscored", "foster", "facilitate", "spearhead", "elevate", "unlock", "unleash", "embody", "supercharge",
            "navigate", "reimagine", "redefine", "reshape", "galvanize", "orchestrate", "operationalize", "catalyze",
            "amplify", "illuminate", "demystify", "unpack", "champion", "empower", "showcase", "showcases", "showcasing",
            "bolster", "bolstered", "enhance", "garner", "garnered", "elucidate", "encompass", "exemplify", "expedite",
            "cultivate", "propel", "revolutionize", "underpin", "underpins",
        ),
    ),
    (
        "lexical.overused-nouns",
        "standard",
        (
            "tapestry", "testament", "landscape", "realm", "synergy", "paradigm", "ecosystem", "cornerstone", "beacon",
            "bedrock", "nexus", "interplay", "plethora", "myriad", "journey", "quest", "canvas", "mosaic", "symphony",
            "fabric", "scaffold", "flywheel", "intricacies", "complexities", "camaraderie", "north star", "value proposition",
            "deep dive", "double down", "treasure trove", "game-changer",
        ),
    ),
    (
        "lexical.inflated-adjectives",
        "aggressive",
        (
            "robust", "seamless", "comprehensive", "meticulous", "pivotal", "crucial", "vital", "transformative",
            "innovative", "multifaceted", "holistic", "nuanced", "intricate", "unparalleled", "cutting-edge", "game-changing",
            "state-of-the-art", "impactful", "actionable", "world-class", "best-in-class", "future-proof", "next-generation",
            "bespoke", "curated", "thought-provoking", "dependable", "indispensable", "mission-critical", "vibrant",
            "commendable", "compelling", "enduring", "captivating", "unwavering", "paramount",
        ),
    ),
    (
        "lexical.llm-tics",
        "aggressive",
        (
            "notably", "arguably", "ultimately", "fundamentally", "inherently", "invariably", "ostensibly", "decidedly",
            "remarkably", "tellingly", "crucially", "importantly", "holistic", "robustly", "simply", "meticulously",
            "intriguingly", "curiously",
        ),
    ),
    (
        "lexical.hedges",
        "aggressive",
        (
            "perhaps", "potentially", "arguably", "conceivably", "presumably", "generally", "typically", "usually", "often",
            "sometimes", "relatively", "fairly", "somewhat", "it depends", "that said", "in some cases", "to some extent",
        ),
    ),
    (
        "phrasal.throat-clearing",
        "standard",
        (
            "it's worth noting", "it is worth noting", "it is important to note", "it should be noted",
            "in today's fast-paced world", "when it comes to", "a testament to", "navigating the complexities of",
            "dive into", "embark on a journey", "at the end of the day", "needless to say", "with that in mind",
            "here's the thing", "the bottom line is", "in the ever-evolving landscape", "in the realm of", "at its core",
            "the real question is", "in a nutshell", "spoiler alert", "in today's digital age",
            "in today's interconnected world", "in an era where", "it's no secret that", "let's face it", "as we navigate",
            "the world of today demands",
        ),
    ),
    (
        "phrasal.machine-residue",
        "light",
        (
            "as an ai", "as a large language model", "as an ai language model", "as an ai assistant", "i hope this helps",
            "certainly!", "great question", "i cannot fulfill", "i'm unable to", "i can't help with that",
            "i don't have personal opinions", "my knowledge cutoff", "my training data", "as of my last update",
            "i cannot browse", "i can't browse the internet", "i don't have access to real-time", "as of my knowledge cutoff",
            "i cannot access the internet", "i do not have real-time access", "i'm not able to browse",
            "my last training update", "i don't have browsing capabilities",
        ),
    ),
    (
        "phrasal.chatgpt-residue",
        "light",
        (
            "as an ai,", "as an ai language model", "i'm sorry, but i can", "i cannot fulfill", "sure! here", "sure, here's",
            "let me know if you", "is there anything else", "i hope this helps!", "here's a breakdown",
            "let's break this down", "here's how", "would you like me to", "do you want me to", "shall i continue",
            "here's the updated", "let me know if you'd like",
        ),
    ),
    (
        "phrasal.claude-residue",
        "aggressive",
        (
            "i'd be happy to", "happy to help", "you're absolutely right", "that's a great question", "i appreciate you",
            "let me be direct", "to be clear", "the honest answer", "the single most", "single most important",
            "what matters here", "why it matters", "this matters because", "and that matters because", "less like a",
            "more like a", "not simply", "here's what i'd recommend", "here's my take",
        ),
    ),
    (
        "phrasal.gemini-affirmations",
        "standard",
        (
            "absolutely!", "of course!", "i'd be happy to", "here are a few", "in essence,", "it's important to remember",
            "it's worth mentioning", "furthermore,", "moreover,", "additionally,", "consequently,", "in addition,",
            "as such,", "therefore,", "thus,",
        ),
    ),
    (
        "phrasal.negative-parallelism",
        "aggressive",
        (
            "not just", "not only", "more than just", "isn't just", "is not just", "not merely", "not simply", "less like",
            "not because", "but rather", "rather than", "instead of merely", "it's not about", "it isn't about",
            "not only about", "no longer just", "more than a mere",
        ),
    ),
    (
        "phrasal.superlative-framing",
        "aggressive",
        (
            "one of the most", "the single most", "the most important thing", "arguably the", "the defining",
            "the definitive", "unquestionably", "without a doubt", "beyond question",
        ),
    ),
    (
        "phrasal.sycophancy",
        "standard",
        (
            "great question", "excellent question", "fantastic question", "you're absolutely right", "that's a fantastic",
            "happy to help", "let me know if", "feel free to", "would you like me to", "is there anything else",
            "just let me know", "i'm here to help", "hope this helps", "don't hesitate to", "great point", "excellent point",
            "couldn't agree more", "wonderful question", "i love this question", "absolutely spot on",
        ),
    ),
    (
        "phrasal.formal-transitions",
        "aggressive",
        (
            "moreover,", "furthermore,", "that being said", "without further ado", "buckle up", "in conclusion,",
            "in summary,", "to sum up", "all in all", "all things considered", "on the whole", "it goes without saying",
            "last but not least",
        ),
    ),
    (
        "phrasal.invitation-openers",
        "aggressive",
        (
            "let's dive in", "let's dive into", "let's explore", "let's break it down", "let's take a look", "let's unpack",
            "let's get into", "imagine this", "picture this", "consider this", "think of it as", "here's the deal",
        ),
    ),
    (
        "phrasal.fake-authority",
        "aggressive",
        (
            "studies show", "research shows", "studies have shown", "experts agree", "experts say", "scientists agree",
            "it's widely known", "it is widely believed", "many people believe", "industry experts", "best practices suggest",
            "data suggests", "evidence suggests", "research suggests", "studies indicate", "experts recommend",
            "it is widely acknowledged", "it is generally accepted",
        ),
    ),
    (
        "phrasal.ai-disclaimer",
        "light",
        (
            "this document was generated", "this article was generated", "generated with the assistance of ai",
            "written by ai", "created using ai", "co-authored with ai", "ai-assisted", "ai-generated", "generated by an ai",
            "produced with ai", "this content was created using", "ai writing assistant",
        ),
    ),
    (
        "phrasal.model-self-reference",
        "standard",
        (
            "as an ai language model, i", "i'm an ai assistant", "i am an ai assistant", "i'm just a language model",
            "i don't have feelings", "i don't have experiences", "i cannot feel", "i can't feel", "i don't have a body",
            "my knowledge cutoff", "my training data",
        ),
    ),
    (
        "structural.markdown-tells",
        "aggressive",
        (
            "## ", "### ", "- [ ]", "- [x]", "1. **", "> **",
        ),
    ),
    (
        "structural.heading-emoji",
        "aggressive",
        (
            "why it matters", "what this means for you", "the bottom line", "key takeaways", "what's next", "how it works",
            "the takeaway",
        ),
    ),
    (
        "phrasal.copula-avoidance",
        "aggressive",
        (
            "serves as", "stands as", "functions as", "operates as", "boasts a", "boasts an", "features a", "features an",
            "marks a significant", "represents a significant",
        ),
    ),
    (
        "phrasal.trailing-participles",
        "aggressive",
        (
            "highlighting the", "highlighting its", "emphasizing the", "underscoring the", "showcasing the", "reflecting a",
            "reflecting the", "solidifying its", "cementing its", "reinforcing its", "enhancing its",
        ),
    ),
    (
        "phrasal.academic-formulas",
        "aggressive",
        (
            "plays a crucial role", "plays a vital role", "plays a pivotal role", "play a crucial role", "a growing body of",
            "sheds light on", "paves the way for", "paving the way for", "has emerged as", "have emerged as",
            "gained traction", "in the context of", "in recent years,", "a burgeoning field",
        ),
    ),
    (
        "phrasal.marketing-formulas",
        "aggressive",
        (
            "unlock the power of", "harness the power of", "elevate your", "supercharge your", "to the next level",
            "revolutionize the way", "say goodbye to", "look no further", "whether you're a", "no matter your",
            "welcome to the future of", "the future is here",
        ),
    ),
    (
        "phrasal.promotional-puffery",
        "aggressive",
        (
            "nestled in the heart of", "in the heart of", "renowned for", "hidden gem", "rich cultural heritage",
            "rich tapestry of", "diverse array of", "breathtaking views", "must-visit", "commitment to excellence",
            "natural beauty",
        ),
    ),
    (
        "phrasal.professional-disclaimer",
        "standard",
        (
            "this is not medical advice", "this is not legal advice", "this is not financial advice",
            "i am not a medical professional", "i'm not a medical professional", "i am not a lawyer",
            "consult a healthcare professional", "consult a qualified professional", "seek professional advice",
            "this does not constitute",
        ),
    ),
    (
        "phrasal.rhetorical-pivots",
        "aggressive",
        (
            "but what does this mean", "what does this mean for you", "here's the kicker", "plot twist", "sound familiar",
            "the catch?", "the twist?", "why should you care",
        ),
    ),
    (
        "lexical.fr.overused-verbs",
        "standard",
        (
            "explorer", "souligner", "mettre en lumi\xe8re", "mettre en \xe9vidence", "favoriser", "faciliter", "tirer parti",
            "exploiter", "renforcer", "approfondir", "incontournable", "essentiel", "remarquable", "fascinant", "riche",
            "complexe", "dynamique",
        ),
    ),
    (
        "phrasal.fr.assistant-formulas",
        "standard",
        (
            "il est important de noter", "il convient de noter", "il est essentiel de", "il faut souligner que",
            "il est int\xe9ressant de noter", "dans le paysage actuel", "dans un monde en constante \xe9volution",
            "\xe0 l'\xe8re du num\xe9rique", "en conclusion", "pour conclure", "en r\xe9sum\xe9", "plongeons dans",
            "n'h\xe9sitez pas \xe0", "j'esp\xe8re que cela vous aidera", "excellente question",
        ),
    ),
    (
        "lexical.es.overused-verbs",
        "standard",
        (
            "explorar", "destacar", "subrayar", "fomentar", "facilitar", "aprovechar", "impulsar", "potenciar", "fortalecer",
            "mejorar", "fundamental", "esencial", "crucial", "notable", "fascinante", "enriquecedor", "complejo",
            "din\xe1mico",
        ),
    ),
    (
        "phrasal.es.assistant-formulas",
        "standard",
        (
            "es importante se\xf1alar", "cabe destacar", "es fundamental tener en cuenta", "es importante tener en cuenta",
            "en el panorama actual", "en un mundo en constante evoluci\xf3n", "en la era digital", "en conclusi\xf3n",
            "para concluir", "en resumen", "profundicemos en", "no dudes en", "espero que esto te ayude",
            "excelente pregunta",
        ),
    ),
    (
        "lexical.grok-tics",
        "aggressive",
        (
            "causal", "causally", "correlate", "correlates", "empirically",
        ),
    ),
    (
        "phrasal.notability-boilerplate",
        "aggressive",
        (
            "has been featured in", "has garnered attention", "garnered widespread", "received widespread acclaim",
            "has been widely covered", "attracted significant attention", "has become a household name",
            "is widely regarded as", "has established itself as", "continues to be a leading", "is known for its",
            "has received numerous awards", "drew widespread praise",
        ),
    ),
    (
        "phrasal.source-hedging",
        "standard",
        (
            "based on the information available", "based on available information", "as of my last knowledge",
            "i don't have access to", "i do not have access to", "i couldn't find", "i could not find",
            "i wasn't able to find", "i was unable to find", "i don't have the latest", "please verify this information",
            "for the most up-to-date", "i recommend checking", "this information may be outdated", "you may want to verify",
            "i don't have real-time",
        ),
    ),
    (
        "phrasal.optimistic-endings",
        "aggressive",
        (
            "despite these challenges", "despite the challenges", "despite these obstacles", "the future looks bright",
            "the future is bright", "only time will tell", "remains to be seen", "one thing is clear", "one thing is certain",
        ),
    ),
    (
        "phrasal.social-post-register",
        "aggressive",
        (
            "here's what actually happened", "here's the thing about", "the privilege of", "if you're like me",
            "we've all been there", "let me explain why", "the best part?", "no one talks about", "nobody talks about",
            "and that's okay",
        ),
    ),
    (
        "phrasal.letter-formulas",
        "aggressive",
        (
            "i hope this email finds you well", "i hope this message finds you well", "i hope this finds you well",
            "i wanted to reach out", "i am reaching out", "i'm reaching out", "i trust this email",
            "thank you for your time and consideration", "at your earliest convenience",
        ),
    ),
)
