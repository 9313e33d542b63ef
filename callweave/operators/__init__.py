"""callweave.operators"""
