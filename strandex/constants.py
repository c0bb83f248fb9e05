"""Chemistry tables and geometric thresholds (ångström, degrees)."""

#: Names of water residues.
WATER = ("HOH", "WAT", "H2O", "DOD", "TIP")
#: Elements taken for metals.
METALS = (
    "LI", "NA", "MG", "AL", "K", "CA", "CR", "MN", "FE", "CO", "NI", "CU", "ZN", "GA", "RB", "SR", "RU", "RH", "PD", "AG", "CD", "IN", "SB", "CS", "BA", "LA", "CE", "PR", "SM", "EU", "GD",
    "TB", "YB", "LU", "W", "OS", "IR", "PT", "AU", "HG", "TL", "PB",
)
#: The twenty standard residues and the nucleotides.
AMINO = tuple("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split())
NUCLEOTIDES = tuple("DA DC DG DT DU DI A C G U I".split())
BACKBONE = ("N", "CA", "C", "O")

#: Van der Waals radii, and the radius of other elements.
VDW = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "H": 1.20, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98, "FE": 1.80, "ZN": 1.39, "MG": 1.73, "CA": 1.97}
VDW_OTHER = 1.70
#: Covalent radii; other elements make no inter-residue bonds.
COVALENT = {"C": 0.76, "N": 0.71, "O": 0.66, "P": 1.07, "S": 1.05, "F": 0.57, "CL": 1.02, "BR": 1.20, "I": 1.39, "SE": 1.20, "B": 0.84, "SI": 1.11, "AS": 1.19}
#: Largest accessible area of each residue.
MAX_ASA = {"ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLN": 225.0, "GLU": 223.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0, "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0}
#: Hydropathy by three-letter code, and the one-letter codes.
HYDROPATHY = {"ILE": 4.5, "VAL": 4.2, "LEU": 3.8, "PHE": 2.8, "CYS": 2.5, "MET": 1.9, "ALA": 1.8, "GLY": -0.4, "THR": -0.7, "SER": -0.8, "TRP": -0.9, "TYR": -1.3, "PRO": -1.6, "HIS": -3.2, "GLU": -3.5, "GLN": -3.5, "ASP": -3.5, "ASN": -3.5, "LYS": -3.9, "ARG": -4.5}
ONE_LETTER = {"A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "Q": "GLN", "E": "GLU", "G": "GLY", "H": "HIS", "I": "ILE", "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL"}

#: Interaction kinds in order, with contact energy (kJ/mol) and short label.
KINDS = ("hydrogen-bond", "salt-bridge", "hydrophobic", "pi-stacking", "pi-cation", "halogen-bond", "water-bridge", "metal-coordination", "disulfide")
SHORT = {
    "hydrogen-bond": "H-bond", "salt-bridge": "salt", "hydrophobic": "phobic", "pi-stacking": "π-stack", "pi-cation": "π-cation", "halogen-bond": "halogen", "water-bridge": "water",
    "metal-coordination": "metal", "disulfide": "S-S",
}
ENERGY = {"hydrogen-bond": 20.0, "salt-bridge": 17.0, "hydrophobic": 0.3, "pi-stacking": 10.0, "pi-cation": 12.5, "halogen-bond": 12.0, "water-bridge": 12.5, "metal-coordination": 70.0, "disulfide": 251.0}

#: Charged groups of standard residues: sign and atoms.
CHARGED = {"ASP": (-1, ("OD1", "OD2")), "GLU": (-1, ("OE1", "OE2")), "ARG": (1, ("NE", "NH1", "NH2")), "LYS": (1, ("NZ",)), "HIS": (1, ("ND1", "NE2"))}
#: Aromatic rings of standard residues, in ring order.
RINGS = {"PHE": (("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),), "TYR": (("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),), "HIS": (("CG", "ND1", "CE1", "NE2", "CD2"),), "TRP": (("CG", "CD1", "NE1", "CE2", "CD2"), ("CD2", "CE2", "CZ2", "CH2", "CZ3", "CE3"))}
#: Metal-binding side-chain atoms (any O or OXT binds too).
METAL_DONORS = {"ASP": ("OD1", "OD2"), "GLU": ("OE1", "OE2"), "SER": ("OG",), "THR": ("OG1",), "TYR": ("OH",), "HIS": ("ND1", "NE2"), "CYS": ("SG",)}
#: Heavy-atom chains of the side chains; backbone bonds are common to all.
BACKBONE_BONDS = (("N", "CA"), ("CA", "C"), ("C", "O"), ("C", "OXT"))
SIDE_CHAINS = {
    "ALA": (), "GLY": (), "ARG": ("CB CG CD NE CZ", "CZ NH1", "CZ NH2"), "ASN": ("CB CG", "CG OD1", "CG ND2"), "ASP": ("CB CG", "CG OD1", "CG OD2"), "CYS": ("CB SG",),
    "GLN": ("CB CG CD", "CD OE1", "CD NE2"), "GLU": ("CB CG CD", "CD OE1", "CD OE2"), "HIS": ("CB CG", "CG ND1 CE1 NE2 CD2 CG"), "ILE": ("CB CG1", "CB CG2", "CG1 CD1"),
    "LEU": ("CB CG", "CG CD1", "CG CD2"), "LYS": ("CB CG CD CE NZ",), "MET": ("CB CG SD CE",), "PHE": ("CB CG", "CG CD1 CE1 CZ CE2 CD2 CG"), "PRO": ("CB CG CD N",),
    "SER": ("CB OG",), "THR": ("CB OG1", "CB CG2"), "TRP": ("CB CG", "CG CD1 NE1 CE2 CD2 CG", "CD2 CE3 CZ3 CH2 CZ2 CE2"), "TYR": ("CB CG", "CG CD1 CE1 CZ CE2 CD2 CG", "CZ OH"), "VAL": ("CB CG1", "CB CG2"),
}
#: Donor classes of standard side chains: class, hydrogens, antecedents.
DONORS = {
    ("ARG", "NE"): ("bisector", 1), ("TRP", "NE1"): ("bisector", 1), ("HIS", "ND1"): ("bisector", 1), ("HIS", "NE2"): ("bisector", 1),
    ("ASN", "ND2"): ("planar", 2), ("GLN", "NE2"): ("planar", 2), ("ARG", "NH1"): ("planar", 2), ("ARG", "NH2"): ("planar", 2),
    ("SER", "OG"): ("rotor", 1), ("THR", "OG1"): ("rotor", 1), ("TYR", "OH"): ("rotor", 1), ("LYS", "NZ"): ("rotor", 3),
}

#: Distances.
LEAST = 0.5
HBOND, SALT, HYDROPHOBIC, PI_STACK, PI_CATION, HALOGEN, METAL, DISULFIDE = 4.1, 5.5, 4.0, 5.5, 6.0, 4.0, 3.0, 2.5
WATER_LEGS = (2.5, 4.1)
COVALENT_SLACK, COVALENT_REACH = 0.4, 2.6
PEPTIDE = 2.5
CALPHA = (2.5, 4.2)
#: Angles.
HBOND_ANGLE = 100.0
PLANE_ANGLE, OFFSET = 30.0, 2.0
HALOGEN_DONOR, HALOGEN_ACCEPTOR, HALOGEN_SLACK = 165.0, 120.0, 30.0
WATER_OMEGA, WATER_THETA = (71.0, 140.0), 100.0
#: Halogen bonds: donors, acceptors, and what the acceptor hangs on.
HALOGENS, HALOGEN_ACCEPTORS, ANTECEDENTS = ("CL", "BR", "I"), ("O", "N", "S"), ("C", "N", "P", "S")
#: Backbone hydrogen bonds: factor (0.084 * 332), energy limit, least energy, coincidence, search radius.
DSSP_FACTOR, DSSP_LIMIT, DSSP_FLOOR, DSSP_SAME, DSSP_REACH = 0.084 * 332, -0.5, -9.9, 0.1, 6.0
#: Placed hydrogens: bond length, sp2, sp3 and H-X-H angles.
BOND_H, SP2, SP3, HXH = 1.0, 120.0, 110.0, 109.5
#: Accessible area: probe radius and points of an atom.
PROBE, POINTS = 1.4, 100


def side_chain_bonds() -> list[tuple[str, str, str]]:
    """(residue, atom, atom) of every heavy-atom bond of the standard residues."""
    out = []
    for resn, chains in SIDE_CHAINS.items():
        pairs = [*BACKBONE_BONDS] + ([] if resn == "GLY" else [("CA", "CB")])
        for chain in chains:
            names = chain.split()
            pairs += list(zip(names, names[1:], strict=False))
        out += [(resn, a, b) for a, b in dict.fromkeys(pairs)]
    return out
