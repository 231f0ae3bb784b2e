"""colloquy.sources"""
